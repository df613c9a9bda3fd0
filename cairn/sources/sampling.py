"""Samples (S10, S11).  Sampling is the feature here; no other operator limits its input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Digits of the digest that one histogram tells apart, and rows of a class that needs no further one.
_DIGITS, _LAST_CLASS = 4, 10_000
_DIGEST = "__digest"


def seeded_sample(df: DataFrame, rows: int, total: int, seed: int = 42) -> DataFrame:
    """``sample`` with a cap; depends on the partitioning of the input."""
    if total <= rows:
        return df
    return df.sample(False, rows / total, seed).limit(rows)


def hash_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """The same rows for the same seed, whatever the partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    slot = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 1_000_000
    return df.filter(slot < int(fraction * 1_000_000))


def exact_sample(df: DataFrame, rows: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all, if there are fewer), the same for any layout of the input.

    The rows with the smallest digests of seed and key, as ORDER BY digest, key LIMIT rows would choose
    them, without a global order: a histogram over the leading hexadecimal digits finds the class that
    holds the last row, and is refined inside that class until the class is small.  Smaller digests pass a
    filter; only the last class is put in order.  Rows that repeat a key are taken in no certain order.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    marked, prefix, wanted = df.withColumn(_DIGEST, digest), "", rows
    while True:
        size = len(prefix) + _DIGITS
        inside = marked.filter(F.col(_DIGEST).startswith(prefix)) if prefix else marked
        # 65,536 classes at most.
        classes = inside.groupBy(F.substring(_DIGEST, 1, size).alias("c")).agg(F.count(F.lit(1)).alias("n")).orderBy("c").collect()
        for c, n in classes:
            if n > wanted:
                break
            wanted -= n
        else:
            return df if not prefix else marked.filter(F.substring(_DIGEST, 1, len(prefix)) <= prefix).drop(_DIGEST)
        prefix = c
        if n <= _LAST_CLASS or size >= 32:
            break
    sure = marked.filter(F.substring(_DIGEST, 1, len(prefix)) < prefix)
    last = marked.filter(F.col(_DIGEST).startswith(prefix)).orderBy(_DIGEST, key).limit(wanted)
    return sure.unionByName(last).drop(_DIGEST)


def first_rows(df: DataFrame, rows: int, key: str) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(rows)
