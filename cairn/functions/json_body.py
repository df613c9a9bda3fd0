"""JSON text handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.text import strip


def json_body(raw: Column) -> Column:
    """M6: the JSON object inside a response: fences removed, first '{' to last '}'."""
    text = strip(F.coalesce(raw, F.lit("")))
    text = strip(F.regexp_replace(text, "(?i)^```(?:json)?|```$", ""))

    def cut(t: Column) -> Column:
        first = F.instr(t, "{")
        last = F.length(t) - F.instr(F.reverse(t), "}") + 1
        found = (first > 0) & (F.instr(t, "}") > 0) & (last > first)
        return F.when(found, F.substr(t, first, last - first + 1)).otherwise(t)

    return let(text, cut)


def is_json_object(body: Column) -> Column:
    """True for exactly one well-formed JSON object, nothing before or after it."""
    def check(b: Column) -> Column:
        as_list = F.from_json(F.concat(F.lit("["), b, F.lit("]")), "array<string>")
        return F.coalesce(b.startswith("{") & (F.size(as_list) == 1), F.lit(False))

    return let(body, check)


def text_list(value: Column) -> Column:
    """A JSON array (given as text) as array<string>; NULL when it is not an array."""
    return F.when(strip(value).startswith("["), F.from_json(value, "array<string>"))


def usage_tokens(raw_json: Column, name: str = "total_tokens") -> Column:
    """A usage counter inside the stored response document."""
    return F.get_json_object(raw_json, f"$.usage.{name}").try_cast("bigint")


def json_source(raw_json: Column) -> Column:
    return F.get_json_object(raw_json, "$.source")


def json_mode(raw_json: Column) -> Column:
    return F.get_json_object(raw_json, "$.mode")
