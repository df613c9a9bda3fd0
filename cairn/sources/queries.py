"""Read-only queries over registered tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def query(spark: SparkSession, sql: str, args: Mapping | None = None, **tables: DataFrame) -> DataFrame:
    """Parameterised SQL; values are bound, never spliced into the text."""
    return spark.sql(sql, args=dict(args or {}), **tables)


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One (table_name, row_count) row per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
