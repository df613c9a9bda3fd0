"""Checks on annotator output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.json_body import is_json_object, json_body, text_list
from cairn.functions.text import drop_whitespace, first_int, strip, truncated, words_found
from cairn.rules import DEFAULT_RULES, POLARITIES, VERDICT_WORDS, Rules

ASPECT_TYPE = "array<struct<aspect:string,polarity:string,evidence:string>>"
DROPPED_TYPE = "array<struct<aspect:string,evidence:string,reason:string>>"


def evidence_in_text(evidence: Column, content: Column) -> Column:
    """Evidence must be a substring of the text, also after removing whitespace."""
    text = F.coalesce(content, F.lit(""))
    return (evidence != "") & (
        text.contains(evidence) | drop_whitespace(text).contains(drop_whitespace(evidence))
    )


def parsed_aspects(items: Column) -> Column:
    """M8: each element of the aspect list as a struct of stripped fields (NULL fields if absent)."""
    parsed = F.transform(items, lambda i: F.from_json(i, "aspect string, polarity string, evidence string"))
    return F.zip_with(items, parsed, lambda item, p: F.struct(
        strip(F.coalesce(p["aspect"], F.lit(""))).alias("name"),
        F.lower(strip(F.coalesce(p["polarity"], F.lit("")))).alias("polarity"),
        F.coalesce(p["evidence"], F.lit("")).alias("full"),
        F.coalesce(strip(item).startswith("{"), F.lit(False)).alias("is_object"),
        item.alias("item"),
    ))


def checked_aspects(parsed: Column, content: Column, rules: Rules) -> Column:
    """M8: the checks that need no other element: ``early`` wins over and ``late`` yields to the
    duplicate and limit checks."""
    def check(p: Column) -> Column:
        evidence = truncated(p["full"], rules.evidence_chars)
        return F.struct(
            p["name"].alias("name"), p["polarity"].alias("polarity"), evidence.alias("evidence"),
            p["full"].alias("full"), p["item"].alias("item"),
            F.when(~p["is_object"], "not_an_object").when(~p["name"].isin(*rules.aspects), "unknown_aspect").alias("early"),
            F.when(~p["polarity"].isin(*POLARITIES), "illegal_polarity")
            .when(~evidence_in_text(evidence, content), "evidence_not_in_text").alias("late"),
        )

    return F.transform(parsed, check)


def aspect_reasons(checked: Column, rules: Rules) -> Column:
    """M8: one reason per element, '' for an accepted one.

    Whether a name is a duplicate depends on what was accepted before: a fold over the short list.
    """
    def step(state: Column, c: Column) -> Column:
        reason = F.coalesce(
            c["early"],
            F.when(F.array_contains(state["names"], c["name"]), "duplicate_aspect")
            .when(F.size(state["names"]) >= rules.max_aspects, "over_limit"),
            c["late"], F.lit(""),
        )
        return F.struct(
            F.when(reason == "", F.array_append(state["names"], c["name"])).otherwise(state["names"]).alias("names"),
            F.array_append(state["reasons"], reason).alias("reasons"),
        )

    empty = F.array().cast("array<string>")
    return F.aggregate(checked, F.struct(empty.alias("names"), empty.alias("reasons")), step, lambda s: s["reasons"])


def valid_keywords(items: Column, rules: Rules) -> Column:
    """M9: unique, non-empty, cut to length, at most five, as a comma list."""
    words = F.transform(
        F.coalesce(items, F.array().cast("array<string>")), lambda w: truncated(w, rules.keyword_chars)
    )
    unique = F.array_distinct(F.filter(words, lambda w: w != ""))
    return F.nullif(F.array_join(F.slice(unique, 1, rules.max_keywords), ","), F.lit(""))


def is_usable(raw_text: Column) -> Column:
    """A response that is no JSON object cannot be repaired by rules; it needs another call."""
    return is_json_object(json_body(raw_text))


def _checked_response(raw_text: Column, content: Column, rules: Rules) -> Column:
    """M6-M9 as one struct."""
    names = ("polarity", "intensity", "aspects", "keywords", "summary")
    no_texts = F.array().cast("array<string>")
    bad_list = F.array(F.struct(F.lit("").alias("aspect"), F.lit("").alias("evidence"),
                                F.lit("aspects_not_a_list").alias("reason")))

    def aspects(given: Column) -> Column:
        def split(pairs: Column) -> Column:
            accepted = F.transform(F.filter(pairs, lambda z: z["reason"] == ""), lambda z: F.struct(
                z["c"]["name"].alias("aspect"), z["c"]["polarity"].alias("polarity"), z["c"]["evidence"].alias("evidence")))
            rejected = F.transform(F.filter(pairs, lambda z: z["reason"] != ""), lambda z: F.struct(
                F.when(z["reason"] == "not_an_object", z["c"]["item"]).otherwise(z["c"]["name"]).alias("aspect"),
                F.when(z["reason"] == "evidence_not_in_text", z["c"]["full"]).otherwise("").alias("evidence"),
                z["reason"].alias("reason")))
            no_list = given.isNotNull() & ~strip(given).startswith("[")
            return F.struct(accepted.cast(ASPECT_TYPE).alias("accepted"),
                            F.when(no_list, bad_list).otherwise(rejected).cast(DROPPED_TYPE).alias("dropped"))

        items = F.coalesce(text_list(given), no_texts)
        return let(checked_aspects(parsed_aspects(items), content, rules), lambda c: let(
            F.zip_with(c, aspect_reasons(c, rules), lambda x, r: F.struct(x.alias("c"), r.alias("reason"))), split))

    def outcome(f: Column, polarity: Column, number: Column) -> Column:
        legal = polarity.isin(*POLARITIES)
        # A JSON number is rounded half to even, a text gives its first integer.
        intensity = F.coalesce(
            F.rint(number).cast("int"),
            F.when(~F.lower(f["intensity"]).isin("true", "false"), first_int(f["intensity"]).cast("int")))
        return F.struct(
            F.when(legal, polarity).otherwise("neutral").alias("polarity"),
            let(intensity, lambda i: F.when(i.isNotNull(), F.least(F.greatest(i, F.lit(1)), F.lit(5)))).alias("intensity"),
            legal.cast("int").alias("is_valid"),
            aspects(f["aspects"]).alias("aspects"),
            valid_keywords(text_list(f["keywords"]), rules).alias("keywords"),
            F.nullif(truncated(f["summary"], rules.summary_chars), F.lit("")).alias("summary"),
            F.when(~legal, F.concat(F.lit("illegal polarity: "), polarity)).alias("validation_reason"),
        )

    def from_body(body: Column) -> Column:
        fields = F.from_json(body, ", ".join(f"{n} string" for n in names))
        number = F.from_json(body, "intensity double")["intensity"]
        return let(fields, lambda f: let(
            F.lower(strip(F.coalesce(f["polarity"], F.lit("")))),
            lambda p: let(number, lambda n: outcome(f, p, n))))

    return let(json_body(raw_text), from_body)


def validate_annotations(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """M6-M9: (…, raw_text, content) plus checked fields.  One projection, no shuffle."""
    staged = rows.withColumn("_r", _checked_response(F.col("raw_text"), F.col("content"), rules))
    return staged.select(
        *rows.columns, is_usable(F.col("raw_text")).alias("is_usable"),
        "_r.polarity", "_r.intensity", "_r.is_valid", F.col("_r.aspects.accepted").alias("aspects"),
        F.col("_r.aspects.dropped").alias("dropped_aspects"), "_r.keywords", "_r.summary", "_r.validation_reason",
    )


# --- reports and comparison texts ------------------------------------------------------------------

def _items(value: Column, max_chars: int, max_items: int | None = None) -> Column:
    cut = F.transform(
        F.coalesce(text_list(value), F.array().cast("array<string>")), lambda t: truncated(t, max_chars)
    )
    kept = F.filter(cut, lambda t: t != "")
    return F.slice(kept, 1, max_items) if max_items else kept


REPORT_LISTS = ("advantages", "issues", "visitor_focus")


def validate_reports(rows: DataFrame, summary_max: int = 260, item_max: int = 6, item_chars: int = 40,
                     item_min: int = 2) -> DataFrame:
    """(…, raw_text) plus summary, the three lists and what had to be repaired."""
    body = json_body(F.col("raw_text"))
    fields = F.from_json(body, "summary string, advantages string, issues string, visitor_focus string")
    staged = rows.withColumns({"_ok": is_json_object(body), "_f": fields})
    summary = strip(F.coalesce("_f.summary", F.lit("")))
    full = {name: _items(F.col(f"_f.{name}"), item_chars) for name in REPORT_LISTS}
    repairs = F.array_compact(F.array(
        F.when(F.length(summary) > summary_max, F.lit("summary cut")),
        *[F.when(F.size(c) > item_max, F.lit(f"{n} cut")) for n, c in full.items()],
        *[F.when(F.size(c) < item_min, F.lit(f"{n} short")) for n, c in full.items()],
    ))
    return staged.select(
        *rows.columns, (F.col("_ok") & (summary != "")).alias("is_usable"),
        F.substring(summary, 1, summary_max).alias("summary"),
        *[F.slice(c, 1, item_max).alias(n) for n, c in full.items()],
        repairs.alias("repairs"),
    )


def validate_comparisons(rows: DataFrame, item_chars: int = 50, note_chars: int = 120,
                         differences: tuple[int, int] = (2, 5), reasons: tuple[int, int] = (1, 4)) -> DataFrame:
    """Structure of a comparison text and forbidden verdict words."""
    body = json_body(F.col("raw_text"))
    fields = F.from_json(body, "differences string, possible_reasons string, reliability_note string")
    staged = rows.withColumns({"_ok": is_json_object(body), "_f": fields})
    diffs, why = _items(F.col("_f.differences"), item_chars), _items(F.col("_f.possible_reasons"), item_chars)
    note = truncated(F.col("_f.reliability_note"), note_chars)
    kept_diffs, kept_why = F.slice(diffs, 1, differences[1]), F.slice(why, 1, reasons[1])
    text = F.array_join(F.concat(kept_diffs, kept_why, F.array(note)), " ")
    repairs = F.array_compact(F.array(
        F.when(F.size(diffs) > differences[1], F.lit("differences cut")),
        F.when(F.size(diffs) < differences[0], F.lit("differences short")),
        F.when(F.size(why) > reasons[1], F.lit("possible_reasons cut")),
        F.when(F.size(why) < reasons[0], F.lit("possible_reasons short")),
    ))
    return staged.select(
        *rows.columns, (F.col("_ok") & (F.size(kept_diffs) > 0)).alias("is_usable"),
        kept_diffs.alias("differences"), kept_why.alias("possible_reasons"), note.alias("reliability_note"),
        words_found(text, VERDICT_WORDS).alias("verdict_words"), repairs.alias("repairs"),
    )


def evidence_violations(aspects: DataFrame, reviews: DataFrame) -> DataFrame:
    """Evidence not found literally, split into whitespace-only and genuine mismatches."""
    rows = aspects.filter(F.coalesce("evidence", F.lit("")) != "").join(
        reviews.select("comment_id", "content"), "comment_id"
    )
    text = F.coalesce("content", F.lit(""))
    return rows.filter(~text.contains(F.col("evidence"))).select(
        "comment_id", "aspect_name", "evidence",
        F.when(evidence_in_text(F.col("evidence"), F.col("content")), "whitespace_only")
        .otherwise("genuine").alias("violation"),
    )
