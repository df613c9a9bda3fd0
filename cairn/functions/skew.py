"""Joins against a keyed lookup that stay balanced when one key holds much of the fact side."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT, _PARTS = "__salt", "__parts"


def key_sizes(facts: DataFrame, on: Sequence[str]) -> DataFrame:
    """(key, members): partial counts are combined before the shuffle, so a hot key is cheap here."""
    return facts.groupBy(*on).agg(F.count(F.lit(1)).alias("members"))


def salted_lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    sizes: DataFrame,
    on: Sequence[str],
    salt_by: str,
    rows_per_task: int,
    how: str = "left",
) -> DataFrame:
    """Equi join that splits every key with more than ``rows_per_task`` fact rows.

    A hot key is cut into members / rows_per_task parts and only its lookup rows are repeated, once
    per part.  There are at most total rows / rows_per_task hot keys, so their list is broadcast: facts
    shuffled by the bare key to meet it would bring all rows without a key, and each hot key, to one task.
    Rows without a key match nothing and are spread by their own hash.  Salts are hashes of a
    fact column, so a re-run task puts every row into the same part again.
    """
    hot = F.broadcast(sizes.filter(F.col("members") > rows_per_task).select(
        *on, F.ceil(F.col("members") / rows_per_task).alias(_PARTS)))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    own = F.xxhash64(salt_by)
    left = facts.join(hot, list(on), "left").withColumn(
        _SALT, F.when(no_key, own).otherwise(F.pmod(own, F.coalesce(_PARTS, F.lit(1))))).drop(_PARTS)
    parts = F.sequence(F.lit(0).cast("bigint"), F.coalesce(_PARTS, F.lit(1)) - 1)
    right = lookup.join(hot, list(on), "left").withColumn(_SALT, F.explode(parts)).drop(_PARTS)
    return left.join(right, [*on, _SALT], how).drop(_SALT)
