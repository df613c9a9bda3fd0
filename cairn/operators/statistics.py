"""Entity, time and origin statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import rates
from cairn.operators.cleaning import overseas
from cairn.rules import DEFAULT_RULES, Rules

SCORES = (1, 2, 3, 4, 5)


def valid_region() -> Column:
    """origin region present and not blank."""
    return F.col("ip_province").isNotNull() & (F.length(F.trim("ip_province")) > 0)


def spot_statistics(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A1, A2: every measure of an entity in one aggregation.

    Positive and negative rates divide by scored reviews, image and low-info rates by all.
    """
    score, total, scored = F.col("score"), F.count(F.lit(1)), F.count("score")
    return reviews.groupBy("spot_name").agg(
        total.alias("review_count"),
        rates.mean2(score).alias("avg_score"),
        *[F.count_if(score == s).alias(f"score_{s}") for s in SCORES],
        rates.ratio(F.count_if(score >= 4), scored).alias("positive_rate"),
        rates.ratio(F.count_if(score <= 2), scored).alias("negative_rate"),
        rates.ratio_or_zero(F.count_if(F.col("image_count") > 0), total).alias("image_rate"),
        F.coalesce(F.sum("like_count"), F.lit(0)).alias("total_likes"),
        rates.ratio_or_zero(F.count_if(F.col("is_low_info") == 1), total).alias("low_info_rate"),
        F.count_if(valid_region()).alias("valid_ip_sample"),
        F.min("publish_date").alias("first_comment_date"),
        F.max("publish_date").alias("last_comment_date"),
    ).withColumn("stat_version", F.lit(rules.stat_version))


def time_statistics(reviews: DataFrame, spot_months: bool = False, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Year and month totals, and entity by year, from one scan.

    Rows are first reduced to (entity, month) sums; every other level is a roll-up of that small
    table, so the review rows are shuffled once.  Entity by month is an option, off by default.
    """
    day = F.col("publish_date")
    monthly = (
        reviews.select("spot_name", F.year(day).cast("string").alias("year"),
                       F.date_format(day, "yyyy-MM").alias("month"), "score")
        .filter(F.col("year").isNotNull())
        .groupBy("spot_name", "year", "month")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.count("score").alias("k"))
    )
    levels = [
        F.struct(F.lit("year").alias("period_type"), F.col("year").alias("period"),
                 F.lit("global").alias("scope_type"), F.lit("").alias("scope")),
        F.struct(F.lit("month").alias("period_type"), F.col("month").alias("period"),
                 F.lit("global").alias("scope_type"), F.lit("").alias("scope")),
        F.struct(F.lit("year").alias("period_type"), F.col("year").alias("period"),
                 F.lit("spot").alias("scope_type"), F.col("spot_name").alias("scope")),
    ]
    if spot_months:
        levels.append(F.struct(F.lit("month").alias("period_type"), F.col("month").alias("period"),
                               F.lit("spot").alias("scope_type"), F.col("spot_name").alias("scope")))
    sums = (
        monthly.select(F.explode(F.array(*levels)).alias("l"), "n", "s", "k")
        .groupBy("l.period_type", "l.period", "l.scope_type", "l.scope")
        .agg(F.sum("n").alias("review_count"), F.sum("s").alias("s"), F.sum("k").alias("k"))
    )
    return sums.select(
        "period_type", "period", "scope_type", F.nullif("scope", F.lit("")).alias("spot_name"),
        "review_count", rates.ratio(F.col("s"), F.col("k"), 2).alias("avg_score"),
        F.lit(None).cast("double").alias("sentiment_avg"), F.lit(rules.stat_version).alias("stat_version"),
    )


def origin_statistics(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Share of each origin region, overall and per entity.

    One shuffle of the review rows to (entity, region) counts; the window totals then run over
    at most one row per entity and region.
    """
    per_spot = reviews.filter(valid_region()).groupBy("spot_name", "ip_province").agg(
        F.count(F.lit(1)).alias("review_count")
    )
    overall = per_spot.groupBy("ip_province").agg(F.sum("review_count").alias("review_count")).select(
        F.lit("global").alias("scope_type"), F.lit(None).cast("string").alias("spot_name"),
        "ip_province", "review_count",
    )
    spots = per_spot.select(F.lit("spot").alias("scope_type"), "spot_name", "ip_province", "review_count")
    sample = F.sum("review_count").over(W.partitionBy("scope_type", "spot_name"))
    return (
        overall.unionByName(spots).withColumn("sample_size", sample)
        .select(
            "scope_type", "spot_name", "ip_province", "review_count",
            rates.ratio_or_zero(F.col("review_count"), F.col("sample_size")).alias("ratio"),
            "sample_size", overseas(F.col("ip_province"), rules).alias("is_overseas"),
            F.lit(rules.stat_version).alias("stat_version"),
        )
    )


def dataset_totals(reviews: DataFrame) -> DataFrame:
    """Total, scored, valid-region and low-info rows."""
    return reviews.agg(
        F.count(F.lit(1)).alias("review_count"), F.count("score").alias("scored_count"),
        F.count_if(valid_region()).alias("valid_ip_count"),
        F.count_if(F.col("is_low_info") == 1).alias("low_info_count"),
    )


def weak_label(score: Column) -> Column:
    """2 positive, 1 neutral, 0 negative; filter NULL scores first."""
    return F.when(score >= 4, 2.0).when(score == 3, 1.0).otherwise(0.0)


def polarity_name(code: Column) -> Column:
    """P18."""
    return F.when(code == 2, "positive").when(code == 1, "neutral").otherwise("negative")


def score_distribution(reviews: DataFrame) -> DataFrame:
    """Rows per score with the share of all scored rows, best score first."""
    counts = reviews.filter(F.col("score").isNotNull()).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    # Five rows at most reach this window.
    total = F.sum("n").over(W.partitionBy())
    return counts.select("score", "n", rates.ratio(F.col("n"), total).alias("rate")).orderBy(F.desc("score"))


BUCKETS = (("3000+", 3000), ("1000-2999", 1000), ("500-999", 500), ("100-499", 100), ("10-99", 10))


def volume_buckets(spot_stats: DataFrame, buckets: tuple = BUCKETS, rest: str = "1-9") -> DataFrame:
    """Entities and reviews per volume class, largest class first."""
    label, rank = F.lit(rest), F.lit(len(buckets))
    for i, (name, low) in reversed(list(enumerate(buckets))):
        hit = F.col("review_count") >= low
        label, rank = F.when(hit, name).otherwise(label), F.when(hit, i).otherwise(rank)
    return (
        spot_stats.groupBy(label.alias("bucket"), rank.alias("bucket_rank"))
        .agg(F.count(F.lit(1)).alias("spot_count"), F.sum("review_count").alias("review_count"))
        .orderBy("bucket_rank")
    )


def scope_composition(spots: DataFrame, reviews: DataFrame) -> DataFrame:
    """Entities and reviews per scope.  Reviews are counted per entity before the join."""
    counts = reviews.groupBy("spot_name").agg(F.count("comment_id").alias("n"))
    return (
        spots.select("spot_name", "source_scope").join(counts, "spot_name", "left")
        .groupBy("source_scope")
        .agg(F.count_distinct("spot_name").alias("spot_count"),
             F.coalesce(F.sum("n"), F.lit(0)).alias("review_count"))
        .withColumn("scope_label", scope_label(F.col("source_scope")))
    )


def scope_label(scope: Column) -> Column:
    """P21."""
    return F.when(scope == "tibet", "西藏").otherwise("进藏沿线")


def method_coverage(sentiment: DataFrame) -> DataFrame:
    """Rows per sentiment method."""
    return sentiment.groupBy("method").agg(F.count(F.lit(1)).alias("n"))
