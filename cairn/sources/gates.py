"""Gates that stop a run before anything is written.

These are the only functions of the package that trigger an action and return no DataFrame.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """A source or dimension does not meet its contract."""


def require_rows(df: DataFrame, expected: int, sample: bool = False, what: str = "rows") -> int:
    """A full run must match exactly, a sample may not exceed the full size."""
    return require_count(df.count(), expected, sample, what)


def require_count(found: int, expected: int, sample: bool = False, what: str = "rows") -> int:
    """S12 on a count that was taken before, e.g. by ``cleaning.ObservedRun`` during a write."""
    if sample and found > expected:
        raise GateError(f"sample has {found} {what}, more than the full {expected}")
    if not sample and found != expected:
        raise GateError(f"found {found} {what}, expected {expected}")
    return found


def unknown_entities(reviews: DataFrame, spots: DataFrame, key: str = "spot_name") -> DataFrame:
    """Keys of the facts that the dimension does not have."""
    return reviews.select(key).distinct().join(spots.select(key), key, "left_anti")


def require_known_entities(reviews: DataFrame, spots: DataFrame, key: str = "spot_name") -> None:
    examples = [r[0] for r in unknown_entities(reviews, spots, key).limit(5).collect()]
    if examples:
        raise GateError(f"{key} missing from the dimension, for example {examples}")


def entity_level_counts(spots: DataFrame) -> DataFrame:
    """Total, per-scope and full-evaluation counts in one pass."""
    return spots.agg(
        F.count(F.lit(1)).alias("spots"),
        F.count_if(F.col("source_scope") == "tibet").alias("scope_a"),
        F.count_if(F.col("source_scope") == "route").alias("scope_b"),
        F.count_if(F.col("has_full_evaluation") == 1).alias("full_evaluation"),
    )


def require_entity_counts(spots: DataFrame, expected: Mapping[str, int]) -> dict[str, int]:
    found = entity_level_counts(spots).first().asDict()
    wrong = {k: (found[k], v) for k, v in expected.items() if found[k] != v}
    if wrong:
        raise GateError(f"entity counts differ (found, expected): {wrong}")
    return found


def require_one_of(name: str, value, allowed: Iterable) -> None:
    """argument domain."""
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {allowed}")


def require_between(name: str, value: int, low: int, high: int | None = None) -> None:
    """argument range."""
    if value < low or (high is not None and value > high):
        raise ValueError(f"{name} must be at least {low}" + (f" and at most {high}" if high else ""))
