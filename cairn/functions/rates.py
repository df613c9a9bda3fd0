"""Rounded averages and ratios (P19, P20).  ``round`` on doubles is HALF_UP."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """NULL when the denominator is zero: a missing sample is not a zero rate."""
    return F.when(whole > 0, F.round(part / whole, digits))


def ratio_or_zero(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.coalesce(ratio(part, whole, digits), F.lit(0.0))


def mean2(c: Column) -> Column:
    return F.round(F.avg(c), 2)


def pct_close(value: Column, fact: Column) -> Column:
    """Within half a percentage point."""
    return F.abs(value - fact) <= 0.5


def number_close(value: Column, fact: Column) -> Column:
    """Within max(0.5, 1 % of the fact)."""
    return F.abs(value - fact) <= F.greatest(F.lit(0.5), F.abs(fact) * 0.01)
