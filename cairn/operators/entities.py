"""Entity dimension from review rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import norm_phone, norm_text, phone_parts
from cairn.rules import DEFAULT_RULES, Rules
from cairn.schema import DESCRIPTIVE_COLUMNS


def _candidates(raw: DataFrame) -> DataFrame:
    """(spot_name, field, value, ordinal): the four descriptive fields in long form."""
    values = {name: norm_text(F.col(name)) for name in DESCRIPTIVE_COLUMNS}
    values["phone"] = F.coalesce(norm_phone(F.col("phone")), F.lit(""))
    long_form = F.explode(F.array(*[
        F.struct(F.lit(name).alias("field"), value.alias("value"),
                 (F.get(phone_parts(F.col("phone")), F.lit(0)) if name == "phone" else F.lit(None).cast("string"))
                 .alias("first_part"))
        for name, value in values.items()
    ]))
    return (
        raw.select(norm_text(F.col("spot_name")).alias("spot_name"),
                   F.col("comment_id").try_cast("bigint").alias("ordinal"), long_form.alias("c"))
        .select("spot_name", "ordinal", "c.*")
        .filter(F.col("value") != "")
    )


def representative_values(raw: DataFrame) -> DataFrame:
    """Per entity and field the most frequent value; ties by length, then first seen.

    Two aggregations, both with map-side combine: a hot entity costs one partial row per value.
    'First seen' is the smallest review id.
    """
    counted = _candidates(raw).groupBy("spot_name", "field", "value").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("ordinal", "first_part")).alias("first"),
    )
    best = F.max_by(
        F.struct("value", F.col("first.first_part").alias("first_part"), "n"),
        F.struct("n", F.length("value").alias("size"), (-F.col("first.ordinal")).alias("earliest")),
    )
    return counted.groupBy("spot_name", "field").agg(best.alias("best")).select(
        "spot_name", "field", "best.value", "best.first_part", F.col("best.n").alias("occurrences")
    )


def guarded_phone(value: Column, first_part: Column, rules: Rules) -> Column:
    """A merged phone over the length limit falls back to its first fragment, cut."""
    return F.when(F.length(value) <= rules.phone_max_chars, value).otherwise(
        F.substring(norm_text(first_part), 1, rules.phone_max_chars)
    )


def phone_truncations(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A9 diagnostics: which entities lost part of their phone field."""
    kept = guarded_phone(F.col("value"), F.col("first_part"), rules)
    return (
        representative_values(raw).filter((F.col("field") == "phone") & (F.length("value") > rules.phone_max_chars))
        .select("spot_name", F.length("value").alias("merged_length"), F.length(kept).alias("kept_length"),
                kept.alias("kept"))
    )


def build_spots(raw: DataFrame, scopes: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A10: review count, representative fields, scope and the full-evaluation flag."""
    kept = F.when(F.col("field") == "phone", guarded_phone(F.col("value"), F.col("first_part"), rules)) \
        .otherwise(F.col("value"))
    fields = (
        representative_values(raw).withColumn("kept", kept)
        .groupBy("spot_name").pivot("field", list(DESCRIPTIVE_COLUMNS)).agg(F.first("kept"))
    )
    counts = raw.groupBy(norm_text(F.col("spot_name")).alias("spot_name")).agg(
        F.count(F.lit(1)).alias("review_count")
    )
    return (
        counts.join(fields, "spot_name", "left").join(scopes, "spot_name", "left")
        .select(
            "spot_name", F.coalesce("source_scope", F.lit("tibet")).alias("source_scope"),
            *DESCRIPTIVE_COLUMNS, "review_count",
            (F.col("review_count") >= rules.full_evaluation_min).cast("int").alias("has_full_evaluation"),
        )
    )


def spot_counters(spots: DataFrame) -> DataFrame:
    """A10: per-scope totals and how many entities have each descriptive field."""
    return spots.agg(
        F.count(F.lit(1)).alias("spots"),
        F.count_if(F.col("source_scope") == "tibet").alias("scope_a_spots"),
        F.count_if(F.col("source_scope") == "route").alias("scope_b_spots"),
        F.sum("has_full_evaluation").alias("full_evaluation_spots"),
        *[F.count(name).alias(f"has_{name}") for name in DESCRIPTIVE_COLUMNS],
    )


def with_spot_fields(reviews: DataFrame, spots: DataFrame) -> DataFrame:
    """Every cleaned review with its entity's representative fields."""
    return reviews.join(spots.select("spot_name", *DESCRIPTIVE_COLUMNS), "spot_name", "left")


def natural_id(*columns: str) -> Column:
    """K5: a surrogate key that needs no sequence: a hash of the natural key; ``numbering.numbered`` has gapless ones."""
    return F.xxhash64(*columns)


def attach_spot_id(rows: DataFrame, spot_ids: DataFrame) -> DataFrame:
    """Name to key; run ``gates.require_known_entities`` first, unmatched rows are lost."""
    return rows.join(spot_ids, "spot_name")
