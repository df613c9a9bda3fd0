"""Exact-text duplicates and their representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.skew import salted_lookup_join
from cairn.rules import DEFAULT_RULES, Rules


def duplicate_groups(reviews: DataFrame) -> DataFrame:
    """Texts that occur more than once: (content_key, dup_group_id, members).

    Grouping works on a digest, so the shuffle moves 32 bytes per text, and partial aggregation
    collapses a text that fills a large part of the table before anything is moved.
    """
    keyed = reviews.filter(F.col("content").isNotNull()).select(
        F.unhex(F.sha2("content", 256)).alias("content_key"), "comment_id"
    )
    return (
        keyed.groupBy("content_key")
        .agg(F.min("comment_id").alias("dup_group_id"), F.count(F.lit(1)).alias("members"))
        .filter(F.col("members") > 1)
    )


def flag_exact_duplicates(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """P12 with groups found by A33 instead of a supplied list."""
    groups = duplicate_groups(reviews)
    keyed = reviews.withColumn("content_key", F.unhex(F.sha2("content", 256)))
    joined = salted_lookup_join(
        keyed, groups.drop("members"), groups, ["content_key"], "comment_id", rules.hot_key_rows)
    return joined.drop("content_key").withColumn(
        "is_dup_content", F.col("dup_group_id").isNotNull().cast("int")
    )


def flag_listed_duplicates(reviews: DataFrame, members: DataFrame) -> DataFrame:
    """Flags from the supplied (comment_id, dup_group_id) list; both sides are keyed by id."""
    return reviews.join(members, "comment_id", "left").withColumn(
        "is_dup_content", F.col("dup_group_id").isNotNull().cast("int")
    )


def representatives(reviews: DataFrame) -> DataFrame:
    """(dup_group_id, representative_id, members): the row that is not low-info, longest, smallest id.

    ``row_number() = 1`` over (low info, length desc, id) is a minimum over that tuple, and a
    minimum pre-aggregates: no task ever sees a whole group.
    """
    rank = F.struct("is_low_info", (-F.col("content_length")).alias("shorter"), "comment_id")
    return (
        reviews.filter((F.col("is_dup_content") == 1) & F.col("dup_group_id").isNotNull())
        .groupBy("dup_group_id")
        .agg(F.min(rank)["comment_id"].alias("representative_id"), F.count(F.lit(1)).alias("members"))
    )


def with_representative(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Every row with the representative of its group (NULL outside groups)."""
    found = representatives(reviews)
    return salted_lookup_join(
        reviews, found.drop("members"), found, ["dup_group_id"], "comment_id", rules.hot_key_rows
    )


def flag_overlap(reviews: DataFrame) -> DataFrame:
    """Inclusion and exclusion of the two flags."""
    low, dup = F.col("is_low_info") == 1, F.col("is_dup_content") == 1
    return reviews.agg(
        F.count_if(low).alias("low_info"), F.count_if(dup).alias("dup_content"),
        F.count_if(low & dup).alias("both_flags"), F.count_if(~low & ~dup).alias("neither_flag"),
        F.count(F.lit(1)).alias("total"),
    )
