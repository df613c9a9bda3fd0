"""Read-only views: (tables, parameters) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.operators.statistics import scope_label
from cairn.rules import DEFAULT_RULES, Rules, caliber_notes
from cairn.sources.gates import require_between, require_one_of

RANKING_BY = {"reviews": "review_count", "rating": "avg_score", "positive_rate": "positive_rate"}


def _long(row: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in row.columns])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def overview_totals(reviews: DataFrame, spots: DataFrame) -> DataFrame:
    """(metric, value); one pass over the reviews and one over the entities."""
    flag = lambda c: F.count_if(F.col(c) == 1)
    dup = F.col("is_dup_content") == 1
    review_row = reviews.agg(
        F.count(F.lit(1)).alias("review_count"), flag("is_low_info").alias("low_info_count"),
        F.count_if(dup).alias("dup_count"), F.count_distinct("dup_group_id").alias("dup_group_count"),
        F.count_if(F.col("image_count") > 0).alias("image_review_count"),
        flag("ip_is_unknown").alias("ip_unknown_count"),
        F.count_if(F.col("score").isNull()).alias("score_null_count"),
        F.count_if(~dup).alias("dedup_review_count"),
    )
    spot_row = spots.agg(
        F.count(F.lit(1)).alias("spot_count"),
        F.count_if(F.col("source_scope") == "tibet").alias("spot_scope_a"),
        F.count_if(F.col("source_scope") == "route").alias("spot_scope_b"),
        flag("has_full_evaluation").alias("spot_full_evaluation"),
    )
    return _long(review_row).unionByName(_long(spot_row))


def data_note(reviews: DataFrame, spots: DataFrame) -> DataFrame:
    """Q13: quality counters (metric, value)."""
    review_row = reviews.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.count_if(F.coalesce(strip(F.col("content")), F.lit("")) == "").alias("empty_content"),
        F.count_if(F.col("is_low_info") == 1).alias("low_info"),
        F.count_if(F.col("is_dup_content") == 1).alias("dup_content"),
        F.count_distinct("dup_group_id").alias("dup_groups"),
        F.count_if(F.col("score").isNull()).alias("score_null"),
        F.count_if(F.col("ip_is_unknown") == 1).alias("ip_unknown"),
    )
    return _long(review_row).unionByName(_long(spots.agg(F.count(F.lit(1)).alias("spots"))))


def trend(stat_time: DataFrame, granularity: str = "year", spot: str | None = None) -> DataFrame:
    """L4: one series in period order, global or of one entity."""
    require_one_of("granularity", granularity, ("year", "month"))
    scoped = stat_time.filter(F.col("period_type") == granularity)
    scoped = scoped.filter(F.col("scope_type") == "global") if spot is None else scoped.filter(
        (F.col("scope_type") == "spot") & (F.col("spot_name") == spot))
    return scoped.select("period", "review_count", "avg_score", "sentiment_avg").orderBy("period")


def top_origins(stat_ip: DataFrame, limit: int = 20) -> DataFrame:
    """Most frequent origin regions with the common sample size."""
    require_between("limit", limit, 1, 100)
    return stat_ip.filter(F.col("scope_type") == "global").select(
        "ip_province", "review_count", F.col("ratio").alias("rate"), "is_overseas", "sample_size"
    ).orderBy(F.desc("review_count"), "ip_province").limit(limit)


def origin_summary(stat_ip: DataFrame) -> DataFrame:
    """Number of regions and the sample they rest on."""
    return stat_ip.filter(F.col("scope_type") == "global").agg(
        F.count(F.lit(1)).alias("province_count"), F.coalesce(F.max("sample_size"), F.lit(0)).alias("sample_size"))


def spot_list(spots: DataFrame, stats: DataFrame, keyword: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page of entities by review count."""
    require_between("page", page, 1)
    require_between("page_size", page_size, 1, 100)
    rows = spots.filter(F.col("spot_name").contains(keyword)) if keyword else spots
    return (
        rows.select("spot_name", "source_scope", "has_full_evaluation", "address", "review_count")
        .join(stats.select("spot_name", "avg_score", "positive_rate", "negative_rate"), "spot_name", "left")
        .withColumn("scope_label", scope_label(F.col("source_scope")))
        .orderBy(F.desc("review_count"), "spot_name").offset((page - 1) * page_size).limit(page_size)
    )


def page_totals(spots: DataFrame, keyword: str | None = None) -> DataFrame:
    """L3: total behind a page."""
    rows = spots.filter(F.col("spot_name").contains(keyword)) if keyword else spots
    return rows.agg(F.count(F.lit(1)).alias("total"))


def ranking(spots: DataFrame, stats: DataFrame, by: str = "reviews", limit: int = 20, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Top entities; rates need a minimum sample, ties go to more reviews, then name."""
    require_one_of("by", by, RANKING_BY)
    require_between("limit", limit, 1, 100)
    least = 1 if by == "reviews" else rules.ranking_min_reviews
    return (
        stats.filter(F.col("review_count") >= least)
        .select("spot_name", "review_count", "avg_score", "positive_rate", "negative_rate")
        .join(spots.select("spot_name", "source_scope", "has_full_evaluation"), "spot_name")
        .orderBy(F.col(RANKING_BY[by]).desc_nulls_last(), F.desc("review_count"), "spot_name").limit(limit)
    )


def missing_fields(names: tuple[str, ...] = ("open_time", "phone", "introduction", "poi_url")):
    """Names of empty descriptive fields."""
    return F.array_compact(F.array(*[F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in names]))


def spot_details(spots: DataFrame, stats: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every entity with statistics, missing fields and whether it can be evaluated."""
    rows = spots if "poi_url" in spots.columns else spots.withColumn("poi_url", F.lit(None).cast("string"))
    enough = F.col("review_count") >= rules.full_evaluation_min
    return rows.join(stats.drop("review_count"), "spot_name", "left").select(
        "spot_name", "source_scope", "review_count", "avg_score", "positive_rate", "negative_rate", "image_rate",
        F.date_format("first_comment_date", "yyyy-MM-dd").alias("first_comment_date"),
        F.date_format("last_comment_date", "yyyy-MM-dd").alias("last_comment_date"),
        enough.cast("int").alias("evaluation_available"),
        F.when(~enough, "REVIEW_COUNT_BELOW_THRESHOLD").alias("availability_reason"),
        F.array_join(missing_fields(), ",").alias("missing_fields"),
    )


def task_summary(tasks: DataFrame) -> DataFrame:
    """Tasks by type and status."""
    return tasks.groupBy("task_type", "status").agg(F.count(F.lit(1)).alias("n")).orderBy("task_type", "status")


def task_list(tasks: DataFrame, limit: int = 20, task_type: str | None = None) -> DataFrame:
    """Q11: newest tasks, optionally of one type."""
    require_between("limit", limit, 1, 100)
    rows = tasks.filter(F.col("task_type") == task_type) if task_type else tasks
    return rows.orderBy(F.desc("task_id")).limit(limit)


def task_details(logs: DataFrame) -> DataFrame:
    """Q11, P25: log lines and errors per task, with the decoded detail total."""
    detail = F.from_json("detail_json", "k bigint")
    return logs.groupBy("task_id").agg(
        F.count(F.lit(1)).alias("log_count"), F.count_if(F.col("level") == "ERROR").alias("error_count"),
        F.count_if((F.col("level") == "ERROR") & (F.col("resolved") == 0)).alias("open_errors"),
        F.sum(detail["k"]).alias("detail_total"),
    )


def caliber_table(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Q12: rule key, value and note, with the sample they apply to."""
    notes = caliber_notes(rules)
    entries = (
        ("ip_valid_since", rules.origin_cutoff, notes["origin"]),
        ("min_review_count", str(rules.full_evaluation_min), notes["threshold"]),
        ("aspect_min_sample", str(rules.aspect_min_sample), notes["aspect"]),
        ("low_info_max_length", str(rules.low_info_max_chars), notes["low_info"]),
        ("sentiment_methods", f"{rules.annotated_method},{rules.baseline_method},dict", notes["sentiment"]),
        ("trend_note", None, notes["trend"]),
    )
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).cast("string").alias("value"), F.lit(n).alias("note"))
                     for k, v, n in entries])
    return reviews.agg(F.count(F.lit(1)).alias("sample_size")).select(F.explode(rows).alias("e"), "sample_size").select(
        "e.*", "sample_size")


def with_caliber(answer: DataFrame, note: str, sample_size: str) -> DataFrame:
    """BR-10: every affected answer carries its scope note and sample size."""
    return answer.withColumns({"caliber_note": F.lit(note), "caliber_sample": F.col(sample_size)})
