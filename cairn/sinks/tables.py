"""Keyed upsert, scope replace, child replace and keyed storage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.session import cut_lineage


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key: the one with the largest ``order``; combined before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("r")).select(*keys, *[f"r.{c}" for c in others]) \
        .select(rows.columns)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """K1: one row per key; of the incoming rows of a key the last by ``order`` replaces the existing one."""
    new = latest(incoming, keys, order)
    return existing.join(new.select(*keys), keys, "left_anti").unionByName(new)


def precedence_union(pools: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all pools, one for each key; the first pool that has a key wins.

    Columns are those of the first pool.  Of rows that repeat a key within one pool the smallest is taken,
    so the result does not depend on the layout; a null key is a key like others.  One shuffle, combined
    before it, however many pools there are.
    """
    columns = pools[0].columns
    others = [c for c in columns if c not in keys]
    rows = reduce(DataFrame.unionByName, [p.select(*columns, F.lit(i).alias("__pool")) for i, p in enumerate(pools)])
    best = F.min(F.struct("__pool", *others))
    return rows.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in others]).select(*columns)


def replace_children(existing: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """K4: all child rows of the given parents make way for the new set, which may be empty."""
    return existing.join(parents.select(key).distinct(), key, "left_anti").unionByName(incoming)


class KeyedTable:
    """A Parquet table in ``buckets`` folders by key hash; a merge rewrites only the buckets it touches.

    Spark's dynamic partition overwrite replaces whole buckets at commit, so a job that dies half-way
    changes nothing.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def create(self, df: DataFrame) -> None:
        self._bucketed(latest(df, self.keys, self.order)).write.mode("errorifexists").partitionBy("bucket").parquet(self.path)

    def merge(self, incoming: DataFrame) -> None:
        """K1 on storage; running it twice with the same rows changes nothing."""
        rows = self._bucketed(incoming)
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets``
        stored = self.spark.read.parquet(self.path).filter(F.col("bucket").isin(touched)).drop("bucket")
        # The rows to keep are read from the folders that are replaced, so they are stored first.
        merged = cut_lineage(self._bucketed(upsert(stored, incoming, self.keys, self.order)))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)


def replace_scopes(df: DataFrame, path: str, scope: tuple[str, ...] = ("scope_type", "scope_id")) -> None:
    """K3: only the scopes present in ``df`` are rewritten."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, batch_size: int = 500, mode: str = "append", **options: str) -> None:
    """K2: executors write in batches; nothing passes through the driver."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch_size), **options).mode(mode).save()


def still_missing(planned: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Planned rows that did not arrive."""
    return planned.join(target.select(*keys), keys, "left_anti")
