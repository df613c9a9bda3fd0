"""Fact packages, representative reviews and report views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.operators.numbers import percent_facts
from cairn.operators.opinions import aspect_statistics, sentiment_distribution
from cairn.rules import DEFAULT_RULES, POLARITIES, Rules


#: A key's rows are ranked in so many parts before they meet.
PARTS = 64


def _top(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank_no") -> DataFrame:
    """N rows per key, by rank within (key, part of the ids) and then within the key.

    The first rank spreads a hot key over PARTS tasks; n rows of each part remain for the second.
    """
    part = F.pmod(F.xxhash64("comment_id"), F.lit(PARTS))
    first = df.withColumn("_part", part).withColumn(
        "_rank", F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_rank") <= n)
    return first.drop("_part", "_rank").withColumn(
        rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)


def representative_reviews(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Up to five positive and negative texts per entity.

    Texts of preferred length come first, then likes, then the smaller id.  Only ids are ranked; the
    texts are joined to the few that are picked.
    """
    score = F.col("score")
    side = F.when(score >= 4, "positive").when(score <= 2, "negative")
    usable = reviews.filter(
        (F.col("is_low_info") == 0) & (F.col("is_dup_content") == 0) & F.col("content").isNotNull()
    ).select("spot_name", side.alias("side"), "comment_id", "content_length", "like_count", "score").filter(F.col("side").isNotNull())
    low, high = rules.representative_chars
    preferred = F.when(F.col("content_length").between(low, high), 0).otherwise(1)
    picked = _top(usable, ["spot_name", "side"], [preferred, F.desc("like_count"), F.asc("comment_id")],
                  rules.representative_max)
    texts = reviews.select("comment_id", F.substring("content", 1, rules.excerpt_chars).alias("content"))
    return picked.drop("content_length").join(texts, "comment_id").select(
        "spot_name", "side", "comment_id", "content", "like_count", "score", "rank_no")


def voices(reviews: DataFrame, aspects: DataFrame, limit: int = 5, skip_low_info: bool = False,
           rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Picked positive, neutral and negative reviews with up to three aspect tags."""
    score = F.col("score")
    group = F.when(score >= 4, "positive").when(score == 3, "neutral").when(score <= 2, "negative")
    usable = reviews.filter(F.coalesce(strip(F.col("content")), F.lit("")) != "")
    if skip_low_info:  # the page-side rule (F7)
        usable = usable.filter((F.col("is_low_info") == 0) & (F.col("is_dup_content") == 0))
    rows = usable.select("spot_name", group.alias("voice"), "comment_id", "like_count", "content_length", "is_dup_content")
    picked = _top(rows.filter(F.col("voice").isNotNull()), ["spot_name", "voice"],
                  [F.asc("is_dup_content"), F.desc("like_count"), F.desc("content_length"), F.asc("comment_id")],
                  limit)
    tags = (
        aspects.filter(F.col("method") == rules.annotated_method)
        .join(picked.select("comment_id"), "comment_id", "left_semi")
        .groupBy("comment_id").agg(F.slice(F.array_sort(F.collect_set("aspect_name")), 1, 3).alias("topics"))
    )
    shown = reviews.select("comment_id", "content", "score", "publish_date", "is_low_info")
    return picked.join(shown, "comment_id").join(tags, "comment_id", "left").withColumn(
        "topics", F.coalesce("topics", F.array().cast("array<string>"))
    )


def fact_packages(spots: DataFrame, stats: DataFrame, sentiment: DataFrame, aspects: DataFrame,
                  reviews: DataFrame, rules: Rules = DEFAULT_RULES, generated_at: Column | None = None) -> DataFrame:
    """One nested document per qualifying entity, all entities in one job."""
    target = spots.filter(F.col("has_full_evaluation") == 1).select(
        "spot_name", "address", "introduction", "source_scope"
    )
    shares = sentiment_distribution(sentiment, digits=2, rules=rules).select(
        "spot_name", F.col("sample_size").alias("sentiment_sample"),
        *[F.col(f"{p}_rate").alias(f"sentiment_{p}") for p in POLARITIES],
    )
    # At most one row per entity and candidate aspect, at most five per entity and side.
    aspect_item = F.struct(
        (-F.col("sample_size")).alias("order_key"), F.col("aspect_name").alias("aspect"), "sample_size",
        "positive_rate", "negative_rate", "note",
    )
    aspect_lists = aspect_statistics(aspects, digits=2, rules=rules).groupBy("spot_name").agg(
        F.transform(F.array_sort(F.collect_list(aspect_item)), lambda a: a.dropFields("order_key")).alias("aspects")
    )
    review_item = F.struct("rank_no", F.col("comment_id").cast("string").alias("comment_id"), "content",
                           "like_count", "score")
    picked = representative_reviews(reviews, rules).groupBy("spot_name").agg(*[
        F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, review_item))),
                    lambda r: r.dropFields("rank_no")).alias(f"{side}_reviews")
        for side in ("positive", "negative")
    ])
    rows = (
        target.join(stats, "spot_name").join(shares, "spot_name", "left")
        .join(aspect_lists, "spot_name", "left").join(picked, "spot_name", "left")
    )
    intro = strip(F.coalesce("introduction", F.lit("")))
    package = F.struct(
        "spot_name", F.lit(rules.package_version).alias("version"),
        (generated_at if generated_at is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        .alias("generated_at"),
        F.struct("address", F.nullif(F.substring(intro, 1, rules.intro_chars), F.lit("")).alias("intro_excerpt"),
                 "source_scope").alias("basic"),
        F.struct("review_count", "avg_score", "positive_rate", "negative_rate", "image_rate", "total_likes",
                 F.struct(F.col("first_comment_date").alias("first"), F.col("last_comment_date").alias("last"))
                 .alias("time_range")).alias("statistics"),
        F.struct(F.lit(rules.annotated_method).alias("method"),
                 F.coalesce("sentiment_sample", F.lit(0)).alias("sample_size"),
                 *[F.col(f"sentiment_{p}").alias(p) for p in POLARITIES]).alias("sentiment"),
        F.coalesce("aspects", F.from_json(F.lit("[]"), ASPECT_ITEM)).alias("aspects"),
        F.struct(*[F.coalesce(f"{side}_reviews", F.from_json(F.lit("[]"), REVIEW_ITEM)).alias(side)
                   for side in ("positive", "negative")]).alias("representative_reviews"),
        F.struct(F.lit(rules.full_evaluation_min).alias("min_review_count"),
                 F.lit(rules.aspect_min_sample).alias("aspect_min_sample"),
                 F.lit(rules.origin_cutoff).alias("ip_valid_since"),
                 F.array(*[F.lit(a) for a in rules.aspects]).alias("candidate_aspects")).alias("caliber"),
    )
    return rows.select(
        "spot_name", F.lit(rules.package_version).alias("version"), package.alias("package"),
        "review_count", "stat_version",
    )


ASPECT_ITEM = "array<struct<aspect:string,sample_size:bigint,positive_rate:double,negative_rate:double,note:string>>"
REVIEW_ITEM = "array<struct<comment_id:string,content:string,like_count:bigint,score:int>>"


def package_table(packages: DataFrame) -> DataFrame:
    """The stored form: the document as JSON text."""
    return packages.select("spot_name", "version", F.to_json("package").alias("package_json"),
                           "review_count", "stat_version", F.col("package.generated_at").alias("generated_at"))


def of_entities(packages: DataFrame, wanted: DataFrame) -> DataFrame:
    """F8: the rows of the listed entities; the list is a table of any size."""
    return packages.join(wanted.select("spot_name").distinct(), "spot_name", "left_semi")


def of_version(packages: DataFrame, version: str) -> DataFrame:
    """F9."""
    return packages.filter(F.col("version") == version)


def missing_packages(packages: DataFrame, existing: DataFrame) -> DataFrame:
    """Only entities that do not have this version yet."""
    return packages.join(existing.select("spot_name", "version"), ["spot_name", "version"], "left_anti")


def package_statistics(packages: DataFrame) -> DataFrame:
    """Counts over the nested documents, without unnesting them."""
    notes = F.col("package.aspects.note")
    return packages.agg(
        F.count(F.lit(1)).alias("packages"),
        F.sum(F.size(F.filter(notes, lambda n: n.isNull()))).alias("aspects_included"),
        F.sum(F.size(F.filter(notes, lambda n: n.isNotNull()))).alias("aspects_excluded"),
        F.count_if(F.col("package.sentiment.sample_size") == 0).alias("without_sentiment"),
    )


def allowed_numbers(packages: DataFrame) -> DataFrame:
    """Per package the percentages and the plain numbers a text may quote."""
    p = F.col("package")
    stats, mood = p["statistics"], p["sentiment"]
    aspect_rates = F.flatten(F.transform(p["aspects"], lambda a: F.array(
        F.round(a["positive_rate"] * 100, 2), F.round(a["negative_rate"] * 100, 2))))
    fixed = percent_facts(stats["image_rate"], stats["positive_rate"], stats["negative_rate"],
                          *[mood[name] for name in POLARITIES])
    plain = F.array_compact(F.array(
        stats["review_count"].cast("double"), stats["avg_score"], stats["total_likes"].cast("double"),
        mood["sample_size"].cast("double")))
    samples = F.transform(p["aspects"], lambda a: a["sample_size"].cast("double"))
    return packages.select(
        "spot_name", "version",
        F.concat(fixed, F.array_compact(aspect_rates)).alias("percent_facts"),
        F.concat(plain, samples).alias("plain_facts"),
    )


def latest_packages(packages: DataFrame) -> DataFrame:
    """The newest stored version per entity, as an aggregate."""
    newest = F.max_by(F.struct("version", "package_json", "generated_at"), F.struct("generated_at", "version"))
    return packages.groupBy("spot_name").agg(newest.alias("p")).select("spot_name", "p.*")


def stale_reports(packages: DataFrame, reports: DataFrame) -> DataFrame:
    """Entities whose report is missing or was written for another package version."""
    return (
        packages.select("spot_name", "version")
        .join(reports.select("spot_name", "fact_package_version"), "spot_name", "left")
        .filter(~F.col("version").eqNullSafe(F.col("fact_package_version")))
        .withColumn("reason", F.when(F.col("fact_package_version").isNull(), "missing").otherwise("outdated"))
    )


def availability(review_count: Column, has_report: Column, rules: Rules) -> Column:
    """P23 / BR-03: reason code, NULL when the evaluation can be shown."""
    return F.when(review_count < rules.full_evaluation_min, "REVIEW_COUNT_BELOW_THRESHOLD").when(
        ~has_report, "REPORT_NOT_GENERATED")


def report_view(spots: DataFrame, stats: DataFrame, packages: DataFrame, reports: DataFrame,
                rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Report, decoded lists and the numbers it rests on (newest package, else statistics)."""
    schema = ("statistics struct<review_count:bigint,avg_score:double,positive_rate:double,negative_rate:double>, "
              f"aspects {ASPECT_ITEM}")
    newest = latest_packages(packages).select(
        "spot_name", F.col("version").alias("basis_version"), F.from_json("package_json", schema).alias("p")
    )
    decoded = reports.select(
        "spot_name", "summary", "need_review", "fact_package_version",
        *[F.from_json(f"{n}_json", "array<string>").alias(n) for n in ("advantages", "issues", "visitor_focus")],
        F.lit(True).alias("_has_report"),
    )
    base = stats.select("spot_name", *[F.col(c).alias(f"s_{c}") for c in
                                       ("review_count", "avg_score", "positive_rate", "negative_rate")])
    rows = (
        spots.select("spot_name", "review_count").join(decoded, "spot_name", "left")
        .join(newest, "spot_name", "left").join(base, "spot_name", "left")
    )
    reason = availability(F.col("review_count"), F.coalesce("_has_report", F.lit(False)), rules)
    has_package = F.col("p").isNotNull()
    by_size = F.array_sort(F.transform(
        F.filter(F.col("p.aspects"), lambda a: F.coalesce(a["sample_size"], F.lit(0)) > 0),
        lambda a: F.struct((-a["sample_size"]).alias("k"), a["aspect"].alias("aspect"), a["sample_size"].alias("n"))))
    show = reason.isNull()
    return rows.select(
        "spot_name", "review_count", show.cast("int").alias("available"), reason.alias("reason"),
        *[F.when(show, F.col(c)).alias(c) for c in ("summary", "advantages", "issues", "visitor_focus", "need_review")],
        F.when(show, F.when(has_package, "fact_package").otherwise("stat_spot")).alias("basis_source"),
        F.when(show, F.col("basis_version")).alias("basis_version"),
        *[F.when(show, F.when(has_package, F.col(f"p.statistics.{c}")).otherwise(F.col(f"s_{c}"))).alias(f"basis_{c}")
          for c in ("review_count", "avg_score", "positive_rate", "negative_rate")],
        F.when(show, F.transform(F.slice(by_size, 1, 5), lambda a: a["aspect"])).alias("top_aspects"),
    )
