"""Sentiment and aspect aggregates over annotation tables (A18-A22, L1-style rankings, F6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import rates
from cairn.functions.text import strip
from cairn.rules import DEFAULT_RULES, POLARITIES, Rules


def _counts(*names: str) -> list[Column]:
    return [F.count_if(F.col("polarity") == p).alias(f"{p}_n") for p in names]


def sentiment_distribution(sentiment: DataFrame, method: str | None = None, digits: int = 4,
                           rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Three fixed classes per entity; rates are NULL without a sample."""
    method = method or rules.annotated_method
    grouped = sentiment.filter(F.col("method") == method).groupBy("spot_name").agg(
        F.count(F.lit(1)).alias("sample_size"), *_counts(*POLARITIES)
    )
    return grouped.select(
        "spot_name", F.lit(method).alias("method"), "sample_size", *[f"{p}_n" for p in POLARITIES],
        *[rates.ratio(F.col(f"{p}_n"), F.col("sample_size"), digits).alias(f"{p}_rate") for p in POLARITIES],
    )


def aspect_statistics(aspects: DataFrame, digits: int = 4, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A19 / BR-04: every aspect is listed, shares only from the minimum sample on."""
    grouped = aspects.filter(F.col("method") == rules.annotated_method).groupBy("spot_name", "aspect_name").agg(
        F.count(F.lit(1)).alias("sample_size"), *_counts(*POLARITIES)
    )
    enough = F.col("sample_size") >= rules.aspect_min_sample
    note = f"fewer than {rules.aspect_min_sample} samples, no conclusion"
    return grouped.withColumns({
        "conclusive": enough.cast("int"),
        "positive_rate": F.when(enough, rates.ratio(F.col("positive_n"), F.col("sample_size"), digits)),
        "negative_rate": F.when(enough, rates.ratio(F.col("negative_n"), F.col("sample_size"), digits)),
        "note": F.when(~enough, note),
    })


def focus_ranking(aspects: DataFrame, top: int = 15, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Most mentioned aspects over all entities, negative share from the minimum sample on."""
    grouped = aspects.filter(F.col("method") == rules.annotated_method).groupBy("aspect_name").agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("polarity") == "negative").alias("negative_n")
    )
    enough = F.col("sample_size") >= rules.aspect_min_sample
    return grouped.select(
        "aspect_name", "sample_size",
        F.when(enough, rates.ratio(F.col("negative_n"), F.col("sample_size"))).alias("negative_rate"),
    ).orderBy(F.desc("sample_size"), "aspect_name").limit(top)


def keyword_frequency(semantic: DataFrame, top: int = 15) -> DataFrame:
    """Counts over all rows of the comma lists."""
    words = semantic.filter(F.coalesce("keywords", F.lit("")) != "").select(
        F.explode(F.transform(F.split("keywords", ","), strip)).alias("keyword")
    )
    return (
        words.filter(F.col("keyword") != "").groupBy("keyword").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "keyword").limit(top)
    )


def most_negative_aspects(aspects: DataFrame, top: int = 10, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Aspects with enough samples by negative share."""
    return (
        aspects.filter(F.col("method") == rules.annotated_method).groupBy("aspect_name")
        .agg(F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("polarity") == "negative").alias("negative_n"))
        .filter(F.col("sample_size") >= rules.aspect_min_sample)
        .withColumn("negative_rate", rates.ratio(F.col("negative_n"), F.col("sample_size")))
        .orderBy(F.desc(F.col("negative_n") / F.col("sample_size")), "aspect_name").limit(top)
    )
