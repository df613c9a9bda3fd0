"""Text cleaning as column expressions (P3-P6, P24, T1 helpers).  All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.rules import PHONE_RESIDUE, WHITESPACE


def strip(c: Column) -> Column:
    """Unicode-aware strip; plain ``trim`` only removes U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def drop_whitespace(c: Column) -> Column:
    """Remove every whitespace character (evidence comparison, Q4)."""
    return F.translate(c, WHITESPACE, "")


def norm_text(c: Column) -> Column:
    """Line breaks to spaces, runs of blanks collapsed, stripped; NULL becomes ''."""
    one_line = F.translate(F.coalesce(c, F.lit("")), "\r\n", "  ")
    return strip(F.regexp_replace(one_line, "[ \\t\\u3000]+", " "))


def to_nullable(c: Column) -> Column:
    """Empty after stripping means missing."""
    return F.nullif(strip(c), F.lit(""))


def phone_parts(c: Column, residue: Sequence[str] = PHONE_RESIDUE) -> Column:
    """P5: fragments of a scraped phone field without page-control residue."""
    pieces = F.transform(F.split(F.coalesce(c, F.lit("")), "[\\r\\n\\t]+"), strip)
    return F.filter(pieces, lambda p: (p != "") & ~p.isin(*residue))


def norm_phone(c: Column) -> Column:
    """Fragments joined by '; ', NULL when nothing is left."""
    return F.nullif(norm_text(F.array_join(phone_parts(c), "; ")), F.lit(""))


def truncated(c: Column, limit: int) -> Column:
    """Stripped, then cut; NULL becomes ''."""
    return F.substring(strip(F.coalesce(c, F.lit(""))), 1, limit)


def first_int(c: Column) -> Column:
    """First integer in a text, NULL if there is none."""
    return F.nullif(F.regexp_extract(c, "-?\\d+", 0), F.lit("")).try_cast("bigint")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True when one of a (short, literal) word list occurs in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | c.contains(word)
    return hit


def words_found(c: Column, words: Sequence[str]) -> Column:
    """The listed words that occur in the text, in list order."""
    return F.array_compact(F.array(*[F.when(c.contains(w), F.lit(w)) for w in words]))


def year_month(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM")
