"""Side-by-side comparison of requested entity pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.rates import ratio
from cairn.operators.opinions import aspect_statistics, sentiment_distribution
from cairn.rules import DEFAULT_RULES, POLARITIES, Rules

# indicator -> digits of its delta
INDICATORS = {"review_count": 0, "avg_score": 2, "positive_rate": 4, "negative_rate": 4, "image_rate": 4, "total_likes": 0}
WARN_RATIO = 10


def snapshots(spots: DataFrame, stats: DataFrame, sentiment: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per entity with statistics and sentiment shares (NULL where absent)."""
    shares = sentiment_distribution(sentiment, rules=rules).select(
        "spot_name", F.col("sample_size").alias("sentiment_sample"),
        *[F.col(f"{p}_rate").alias(f"sentiment_{p}") for p in POLARITIES],
    )
    return (
        spots.select("spot_name", "source_scope", "review_count")
        .join(stats.select("spot_name", *[c for c in INDICATORS if c != "review_count"]), "spot_name", "left")
        .join(shares, "spot_name", "left")
        .withColumn("sentiment_sample", F.coalesce("sentiment_sample", F.lit(0)))
    )


def paired(pairs: DataFrame, entity_rows: DataFrame) -> DataFrame:
    """Both sides of each requested (spot_a, spot_b); a pair with itself is not a comparison."""
    side = {s: entity_rows.select([F.col(c).alias(f"{c}_{s}" if c != "spot_name" else f"spot_{s}")
                                   for c in entity_rows.columns]) for s in ("a", "b")}
    return pairs.filter(F.col("spot_a") != F.col("spot_b")).join(side["a"], "spot_a").join(side["b"], "spot_b")


def _delta(name: str, digits: int) -> Column:
    return F.round(F.col(f"{name}_a").cast("double") - F.col(f"{name}_b").cast("double"), digits)


def pair_differences(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Deltas (NULL if a side has none) and the sample ratio with its reliability warning."""
    a, b = F.col("review_count_a"), F.col("review_count_b")
    sample_ratio = ratio(F.greatest(a, b), F.least(a, b), 2)
    return paired(pairs, snapshot).select(
        "spot_a", "spot_b", (a - b).alias("review_count_delta"),
        _delta("avg_score", 2).alias("avg_score_delta"),
        _delta("positive_rate", 4).alias("positive_rate_delta"),
        _delta("negative_rate", 4).alias("negative_rate_delta"),
        sample_ratio.alias("sample_ratio"),
        (F.coalesce(sample_ratio, F.lit(0.0)) >= WARN_RATIO).cast("int").alias("reliability_warning"),
        F.when(a > b, F.col("spot_a")).when(a < b, F.col("spot_b")).alias("larger_spot"),
    )


def indicator_rows(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """C4: six indicators per pair in long form."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("indicator_no"), F.lit(name).alias("indicator"),
                 F.col(f"{name}_a").cast("double").alias("value_a"),
                 F.col(f"{name}_b").cast("double").alias("value_b"), _delta(name, digits).alias("delta"))
        for i, (name, digits) in enumerate(INDICATORS.items(), 1)
    ])
    return paired(pairs, snapshot).select("spot_a", "spot_b", F.explode(entries).alias("i")).select(
        "spot_a", "spot_b", "i.*")


def aspect_alignment(pairs: DataFrame, aspects: DataFrame, limit: int = 12, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Aspects of both sides, the sample gate applied to each side on its own."""
    stats = aspect_statistics(aspects, rules=rules).select(
        "spot_name", "aspect_name", "sample_size", "conclusive", "positive_rate", "negative_rate")
    keys = ["spot_a", "spot_b", "aspect_name"]
    wanted = pairs.filter(F.col("spot_a") != F.col("spot_b")).select("spot_a", "spot_b")

    def side(name: str) -> DataFrame:
        rows = wanted.join(stats.withColumnRenamed("spot_name", f"spot_{name}"), f"spot_{name}")
        return rows.select(*keys, *[F.col(c).alias(f"{c}_{name}") for c in stats.columns
                                    if c not in ("spot_name", "aspect_name")])

    merged = side("a").join(side("b"), keys, "full")
    larger = F.greatest(F.coalesce("sample_size_a", F.lit(0)), F.coalesce("sample_size_b", F.lit(0)))
    order = W.partitionBy("spot_a", "spot_b").orderBy(F.desc("larger_sample"), F.asc("aspect_name"))
    return (
        merged.withColumn("larger_sample", larger).withColumn("rank_no", F.row_number().over(order))
        .filter(F.col("rank_no") <= limit)
    )


def comparison_facts(pairs: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All numbers a comparison text may quote, per pair (input of C7)."""
    names = [*INDICATORS, "sentiment_sample", *[f"sentiment_{p}" for p in POLARITIES]]
    both = [F.col(f"{n}_{s}").cast("double") for n in names for s in ("a", "b")]
    deltas = [_delta(n, d) for n, d in INDICATORS.items()]
    return paired(pairs, snapshot).select(
        "spot_a", "spot_b", F.array_compact(F.array(*both, *deltas)).alias("facts"))
