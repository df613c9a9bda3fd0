"""Audits of result tables as check tables."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.json_body import json_mode, json_source, usage_tokens
from cairn.functions.text import strip
from cairn.operators.annotation import EXCLUDED, REUSE, RULE
from cairn.operators.validation import evidence_violations
from cairn.rules import DEFAULT_RULES, POLARITIES, Rules
from cairn.schema import DESCRIPTIVE_COLUMNS


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _named(row: DataFrame, names: list[str]) -> DataFrame:
    """One wide row of numbers -> (check_name, actual)."""
    entries = F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(n).cast("double").alias("actual")) for n in names])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def _aggregate(df: DataFrame, **measures: Column) -> DataFrame:
    return _named(df.agg(*[c.alias(n) for n, c in measures.items()]), list(measures))


def _with_expectation(checks: DataFrame, expected: Mapping[str, float], tolerance: float = 1e-9) -> DataFrame:
    wanted = F.lit(None).cast("double")
    for name, value in expected.items():
        wanted = F.when(F.col("check_name") == name, F.lit(float(value))).otherwise(wanted)
    return checks.withColumn("expected", wanted).withColumn(
        "ok", (F.abs(F.col("actual") - F.col("expected")) <= tolerance).cast("int"))


def stat_mismatches(reviews: DataFrame, stats: DataFrame) -> DataFrame:
    """Entities whose stored count differs from a recount."""
    actual = reviews.groupBy("spot_name").agg(F.count(F.lit(1)).alias("actual"))
    return stats.select("spot_name", "review_count").join(actual, "spot_name", "left").filter(
        F.col("review_count") != F.coalesce("actual", F.lit(0)))


def self_check(reviews: DataFrame, spots: DataFrame, stats: DataFrame, origins: DataFrame) -> DataFrame:
    """Q1: counts, sums, bounds and ratio totals of a statistics run: (check_name, actual, expected, ok)."""
    rate = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    table = origins.filter(F.col("scope_type") == "global")
    scores = sum((F.col(f"score_{i}") for i in range(1, 6)), F.lit(0))
    actual = _union([
        _aggregate(stats, stat_rows=F.count(F.lit(1)), review_count_sum=F.sum("review_count"),
                   score_sum=F.sum(scores),
                   rates_out_of_bounds=F.count_if(F.coalesce(rate("positive_rate") | rate("negative_rate"), F.lit(False)))),
        _aggregate(stat_mismatches(reviews, stats), count_mismatches=F.count(F.lit(1))),
        _aggregate(table, origin_ratio_sum=F.round(F.sum("ratio"), 2), origin_denominator=F.max("sample_size")),
    ])
    expected = _union([
        _aggregate(spots, stat_rows=F.count(F.lit(1))),
        _aggregate(reviews, review_count_sum=F.count(F.lit(1)), score_sum=F.count("score"),
                   origin_denominator=F.count("ip_province"), rates_out_of_bounds=F.lit(0),
                   count_mismatches=F.lit(0), origin_ratio_sum=F.lit(1)),
    ]).withColumnRenamed("actual", "expected")
    return actual.join(expected, "check_name").withColumn(
        "ok", (F.abs(F.col("actual") - F.col("expected")) <= 0.01).cast("int"))


def import_measures(reviews: DataFrame, spots: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Q2: the measures an import is verified by: (check_name, actual)."""
    full = spots.filter(F.col("has_full_evaluation") == 1)
    return _union([
        _aggregate(spots, spots=F.count(F.lit(1)), scope_a=F.count_if(F.col("source_scope") == "tibet"),
                   scope_b=F.count_if(F.col("source_scope") == "route"),
                   full_evaluation=F.sum("has_full_evaluation"), review_count_sum=F.sum("review_count")),
        _aggregate(full, full_evaluation_reviews=F.sum("review_count")),
        _aggregate(
            reviews, reviews=F.count(F.lit(1)), low_info=F.sum("is_low_info"), dup_rows=F.sum("is_dup_content"),
            dup_groups=F.count_distinct("dup_group_id"), score_null=F.count_if(F.col("score").isNull()),
            content_null=F.count_if(F.col("content").isNull()), ip_unknown=F.sum("ip_is_unknown"),
            region_filled=F.count("ip_province"), five_star=F.count_if(F.col("score") == 5),
            max_length=F.max("content_length"), distinct_ids=F.count_distinct("comment_id"),
            region_before_cutoff=F.count_if(
                F.col("ip_province").isNotNull() & (F.col("publish_date") < F.lit(rules.origin_cutoff).cast("date"))),
        ),
    ])


REVIEW_LEVEL = (
    "reviews", "low_info", "dup_rows", "dup_groups", "score_null", "content_null", "ip_unknown",
    "region_filled", "five_star", "max_length", "distinct_ids", "region_before_cutoff",
)


def verify_import(reviews: DataFrame, spots: DataFrame, expected: Mapping[str, float], sample: bool = False,
                  rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Q2: measures against expectations; review-level ones are skipped for a sample."""
    checks = _with_expectation(import_measures(reviews, spots, rules), expected)
    return checks.filter(~F.col("check_name").isin(*REVIEW_LEVEL)) if sample else checks


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def integrity(sentiment: DataFrame, aspects: DataFrame, semantic: DataFrame, reviews: DataFrame,
              spots: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(check_name, actual) violation counts of the annotation tables."""
    rows = sentiment.filter(F.col("method") == rules.annotated_method)
    marked = aspects.filter(F.col("method") == rules.annotated_method)
    ids, review_ids = rows.select("comment_id"), reviews.select("comment_id")
    called = json_source(F.col("raw_json")) == rules.annotated_method
    orphans = {
        "orphan_spot": rows.join(spots.select("spot_name"), "spot_name", "left_anti"),
        "orphan_review": rows.join(review_ids, "comment_id", "left_anti"),
        "semantic_without_sentiment": semantic.join(ids, "comment_id", "left_anti"),
        "sentiment_without_semantic": rows.join(semantic.select("comment_id"), "comment_id", "left_anti"),
        "orphan_aspect": aspects.join(ids, "comment_id", "left_anti"),
        "orphan_aspect_review": aspects.join(review_ids, "comment_id", "left_anti"),
        "sentiment_dup_keys": duplicate_keys(rows, ["comment_id"]),
        "aspect_dup_keys": duplicate_keys(marked, ["comment_id", "aspect_name"]),
    }
    counted = [_aggregate(df, **{name: F.count(F.lit(1))}) for name, df in orphans.items()]
    values = _aggregate(
        rows,
        illegal_polarity=F.count_if(~F.col("polarity").isin(*POLARITIES)),
        illegal_intensity=F.count_if(F.coalesce(~F.col("intensity").between(1, 5), F.lit(False))),
        usage_missing=F.count_if(F.coalesce(called, F.lit(False)) & usage_tokens(F.col("raw_json")).isNull()),
        stub_rows=F.count_if(F.coalesce(json_mode(F.col("raw_json")) == "mock", F.lit(False))),
        trace_rows=F.count_if(F.coalesce(json_mode(F.col("raw_json")).isin("mock", "reuse"), F.lit(False))),
    )
    evidence = _aggregate(
        evidence_violations(marked, reviews),
        evidence_not_in_content=F.count_if(F.col("violation") == "genuine"),
        evidence_whitespace_only=F.count_if(F.col("violation") == "whitespace_only"),
    )
    return _union([*counted, values, evidence])


BLOCKING = (
    "sentiment_dup_keys", "aspect_dup_keys", "illegal_polarity", "illegal_intensity", "orphan_spot",
    "orphan_review", "evidence_not_in_content", "semantic_without_sentiment", "sentiment_without_semantic",
    "orphan_aspect", "orphan_aspect_review", "stub_rows", "layers_not_exhaustive", "layer_pending_mismatch",
    "rule_result_on_normal_text", "result_on_empty_text",
)
WARNING = ("usage_missing", "evidence_whitespace_only", "open_failures", "nothing_pending")


def layer_checks(layered: DataFrame, sentiment: DataFrame, semantic: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Layers cover the analysable rows once; results sit in the right layer."""
    done = sentiment.filter(F.col("method") == rules.annotated_method).select("comment_id", F.lit(1).alias("done")).distinct()
    source = semantic.select("comment_id", "source")
    # Told before the joins, so that no text moves through them.
    told = layered.select("comment_id", "layer", "is_low_info", (F.coalesce(strip(F.col("content")), F.lit("")) == "").alias("_empty"))
    rows = told.join(done, "comment_id", "left").join(source, "comment_id", "left")
    empty = F.col("_empty")
    layered_count = F.count_if(F.col("layer").isin(RULE, REUSE, "call"))
    return _aggregate(
        rows,
        layers_not_exhaustive=F.abs(layered_count - F.count_if(~empty)),
        layer_pending_mismatch=F.abs(
            F.count_if((F.col("layer") != EXCLUDED) & F.col("done").isNull())
            - (layered_count - F.count_if((F.col("layer") != EXCLUDED) & F.col("done").isNotNull()))),
        rule_result_on_normal_text=F.count_if((F.col("source") == "rule") & (F.col("is_low_info") == 0)),
        result_on_empty_text=F.count_if(empty & F.col("source").isNotNull()),
        nothing_pending=F.when(F.count_if((F.col("layer") != EXCLUDED) & F.col("done").isNull()) == 0, 1).otherwise(0),
    )


def open_failures(logs: DataFrame, stage: str = "semantic") -> DataFrame:
    return _aggregate(logs, open_failures=F.count_if(
        (F.col("level") == "ERROR") & (F.col("stage") == stage) & (F.col("resolved") == 0)))


def verdict(checks: DataFrame) -> DataFrame:
    """Q6: READY or BLOCKED from (check_name, actual) rows, with what blocks and what warns."""
    hit = F.col("actual") > 0
    name = F.col("check_name")
    return checks.agg(
        F.array_sort(F.collect_set(F.when(hit & name.isin(*BLOCKING), name))).alias("issues"),
        F.array_sort(F.collect_set(F.when(hit & name.isin(*WARNING), name))).alias("warnings"),
    ).select(
        F.when(F.size("issues") == 0, "READY").otherwise("BLOCKED").alias("status"), "issues", "warnings")


def fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Q7: row count and order-free checksum; the sum is decimal so it cannot overflow."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in (columns or df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        # 32 bits of a digest for each row, added up.
        F.coalesce(F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"),
    )


def recompute_mismatches(stored: DataFrame, derived: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Q8: per column how many rows differ between two derivations, plus missing rows."""
    left = stored.select(key, F.struct(*columns).alias("l"))
    right = derived.select(key, F.struct(*columns).alias("r"))
    both = left.join(right, key, "full")
    matched = F.col("l").isNotNull() & F.col("r").isNotNull()
    measures = {c: F.count_if(matched & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))) for c in columns}
    return _aggregate(both, **measures, missing_rows=F.count_if(~matched))


def cross_stage(layered: DataFrame) -> DataFrame:
    """Q9: why the text-modelling input and the call layer differ in size.

    usable = neither low-info nor duplicate; call = usable plus the representatives that are not
    low-info, minus empty texts that carry no flag.
    """
    low, dup = F.col("is_low_info") == 1, F.col("is_dup_content") == 1
    empty = F.coalesce(strip(F.col("content")), F.lit("")) == ""
    call = F.col("layer") == "call"
    row = layered.agg(
        F.count_if(~low & ~dup).alias("usable"), F.count_if(call).alias("call_layer"),
        F.count_if(call & dup).alias("representatives"), F.count_if(~low & ~dup & empty).alias("empty_texts"),
    )
    return row.withColumn(
        "unexplained", F.col("call_layer") - F.col("usable") - F.col("representatives") + F.col("empty_texts"))


def descriptive_dimensions(stat_tables: Mapping[str, DataFrame]) -> dict[str, list[str]]:
    """U4 / BR-09: descriptive fields that leaked into a statistics table (metadata only)."""
    return {name: sorted(set(df.columns) & set(DESCRIPTIVE_COLUMNS)) for name, df in stat_tables.items()}


def annotation_status(sentiment: DataFrame, semantic: DataFrame) -> DataFrame:
    """Q14: rows per method and polarity, rows per source."""
    moods = sentiment.groupBy(F.concat_ws("/", "method", "polarity").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    sources = semantic.groupBy(F.col("source").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return moods.select(F.lit("sentiment").alias("section"), "key", "n").unionByName(
        sources.select(F.lit("semantic").alias("section"), "key", "n"))
