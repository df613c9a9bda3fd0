"""Side files: scope labels, duplicate list, stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.rules import SCOPE_LABELS


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """A headed CSV whose columns are addressed by position."""
    df = spark.read.options(header="true", multiLine="true", quote='"', escape='"', encoding="UTF-8").csv(path)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def scope_labels(rows: DataFrame, labels: dict[str, str] = SCOPE_LABELS, default: str = "tibet") -> DataFrame:
    """(name, label) -> (spot_name, source_scope)."""
    scope = F.lit(default)
    for label, code in labels.items():
        scope = F.when(strip(F.col("label")) == label, F.lit(code)).otherwise(scope)
    return rows.select(strip(F.col("name")).alias("spot_name"), scope.alias("source_scope"))


def read_scope_labels(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_columns(spark, path).select(F.col("c0").alias("name"), F.col("c1").alias("label"))
    return scope_labels(rows)


def duplicate_members(rows: DataFrame, separator: str = "、") -> DataFrame:
    """(group_id, id list) -> one (comment_id, dup_group_id) row per listed id."""
    ids = F.split(F.coalesce(F.col("ids"), F.lit("")), separator)
    return (
        rows.select(F.col("group_id").cast("bigint").alias("dup_group_id"), F.explode(ids).alias("id"))
        .select(strip(F.col("id")).try_cast("bigint").alias("comment_id"), "dup_group_id")
        .filter(F.col("comment_id").isNotNull())
    )


def read_duplicate_members(spark: SparkSession, path: str) -> DataFrame:
    rows = read_text_columns(spark, path)
    return duplicate_members(rows.select(F.col("c0").alias("group_id"), F.col("c5").alias("ids")))


def stop_words(lines: DataFrame) -> DataFrame:
    """Many words per line, '#' comments and the BOM dropped, distinct."""
    text = strip(F.replace(F.col("value"), F.lit("\ufeff"), F.lit("")))
    return (
        lines.select(text.alias("line"))
        .filter((F.col("line") != "") & ~F.col("line").startswith("#"))
        .select(F.explode(F.split("line", "(?U)\\s+")).alias("word"))
        .filter(F.col("word") != "")
        .distinct()
    )


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A hand-kept word list (a few hundred words), as the transformer's parameter."""
    return sorted(r.word for r in stop_words(spark.read.text(path)).collect())
