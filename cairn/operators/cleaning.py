"""Field cleaning and the review record (P3-P14, Q10 counters, A11, A12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.functions import rates
from cairn.functions.text import norm_text, strip, to_nullable
from cairn.rules import DEFAULT_RULES, Rules
from cairn.session import cut_lineage


def parse_day(c: Column) -> Column:
    """Strict year-month-day, NULL for anything else."""
    text = strip(c)
    shaped = F.when(text.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), text)
    return F.try_to_date(shaped, "yyyy-M-d")


def region_columns(location: Column, rules: Rules) -> dict[str, Column]:
    """(unknown flag, region or NULL, overseas flag) of an origin field."""
    value = norm_text(location)
    unknown = (value == "") | (value == rules.unknown_region)
    return {
        "ip_is_unknown": unknown.cast("int"),
        "region": F.when(~unknown, value),
        "is_overseas": F.when(unknown, 0).otherwise(overseas(value, rules)),
    }


def overseas(region: Column, rules: Rules) -> Column:
    """P10: anything outside the domestic list counts as overseas."""
    return (~region.isin(*rules.domestic_regions)).cast("int")


def split_by_date(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable rows and the rejected ones, which stay countable.

    A row is rejected when its date or its id does not parse.
    """
    checked = raw.withColumn("_day", parse_day(F.col("publish_date"))).withColumn(
        "_id", strip(F.col("comment_id")).try_cast("bigint")
    )
    usable = F.col("_day").isNotNull() & F.col("_id").isNotNull()
    return checked.filter(usable), checked.filter(~usable).drop("_day", "_id")


def clean_reviews(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The typed review record, one projection, no shuffle.

    Duplicate flags are added by ``duplicates.flag_duplicates``.
    """
    good = split_by_date(raw)[0].withColumn("_content", strip(F.coalesce("content", F.lit(""))))
    good = good.withColumn("_size", F.length("_content"))
    content, size = F.col("_content"), F.col("_size")
    region = region_columns(F.col("ip_location"), rules)
    # P9 / BR-01: the region is kept only from the cutoff date on.
    in_window = F.col("_day") >= F.lit(rules.origin_cutoff).cast("date")

    def count_field(name: str) -> Column:  # P13
        return F.coalesce(strip(F.col(name)).try_cast("bigint"), F.lit(0))

    return good.select(
        F.col("_id").alias("comment_id"),
        norm_text(F.col("spot_name")).alias("spot_name"),
        strip(F.col("score")).try_cast("int").alias("score"),
        to_nullable(F.col("score_desc")).alias("score_desc"),
        F.nullif(content, F.lit("")).alias("content"),
        size.alias("content_length"),
        F.col("_day").alias("publish_date"),
        F.year("_day").alias("publish_year"),
        F.month("_day").alias("publish_month"),
        F.coalesce(F.nullif(norm_text(F.col("ip_location")), F.lit("")), F.lit(rules.unknown_region)).alias("ip_location"),
        region["ip_is_unknown"].alias("ip_is_unknown"),
        F.when(in_window, region["region"]).alias("ip_province"),
        norm_text(F.col("user_nick")).alias("user_nick"),
        count_field("like_count").alias("like_count"),
        count_field("image_count").cast("int").alias("image_count"),
        to_nullable(F.col("image_urls")).alias("image_urls"),
        # P11 / BR-05
        ((size > 0) & (size <= rules.low_info_max_chars)).cast("int").alias("is_low_info"),
    )


def layering_statistics(reviews: DataFrame) -> DataFrame:
    """Totals, shares, duplicate groups and rows usable for text modelling."""
    low, dup = F.col("is_low_info") == 1, F.col("is_dup_content") == 1
    total = F.count(F.lit(1))
    return reviews.agg(
        total.alias("total"),
        F.count_if(low).alias("low_info"),
        F.count_if(dup).alias("dup_content"),
        F.count_distinct("dup_group_id").alias("dup_groups"),
        F.count_if(~low & ~dup).alias("usable_for_text"),
        rates.ratio_or_zero(F.count_if(low), total).alias("low_info_share"),
        rates.ratio_or_zero(F.count_if(dup), total).alias("dup_share"),
    )


def normalisation_statistics(reviews: DataFrame) -> DataFrame:
    """Empties, lengths, date range and years, in one pass."""
    return reviews.agg(
        F.count_if(F.col("score").isNull()).alias("score_null"),
        F.count_if(F.col("content").isNull()).alias("content_null"),
        F.sum("ip_is_unknown").alias("ip_unknown"),
        F.count("ip_province").alias("ip_province_filled"),
        F.min("content_length").alias("min_length"),
        F.max("content_length").alias("max_length"),
        F.sum("content_length").alias("sum_length"),
        F.min("publish_date").alias("first_date"),
        F.max("publish_date").alias("last_date"),
        F.count_distinct("publish_year").alias("years"),
    )


def step_counters(raw: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Input / output / dropped / abnormal per cleaning step, as one table.

    The texts are read once: rows, rejected and short ones are conditional counts, and a duplicate
    is a surplus row of a (digest, short) group, combined before the shuffle.
    """
    checked = raw.select(
        (parse_day(F.col("publish_date")).isNotNull() & strip(F.col("comment_id")).try_cast("bigint").isNotNull()).alias("good"),
        F.nullif(strip(F.coalesce("content", F.lit(""))), F.lit("")).alias("text"))
    size = F.length("text")
    digests = checked.select(
        "good", F.sha2("text", 256).alias("digest"),
        (F.coalesce(size, F.lit(0)).between(1, rules.low_info_max_chars)).alias("low")
    ).groupBy("good", "digest", "low").agg(F.count(F.lit(1)).alias("n"))
    usable = F.col("good") & ~F.col("low") & (F.col("digest").isNull() | (F.col("n") == 1))
    wide = digests.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("read"),
        F.coalesce(F.sum(F.when(~F.col("good"), F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("clean"),
        F.coalesce(F.sum(F.when(usable, F.col("n"))), F.lit(0)).alias("usable"))
    steps = F.array(
        _step("read source", "read", "read", F.lit(0)),
        _step("normalise fields", "read", "clean", F.col("rejected")),
        _step("mark duplicates and short texts", "clean", "clean", F.lit(0)),
        _step("text modelling input", "clean", "usable", F.lit(0)),
    )
    return wide.select(F.explode(steps).alias("s")).select("s.*").withColumn(
        "detail_json",
        F.to_json(F.struct("input_count", "output_count", "dropped_count", "abnormal_count")),
    )


def _step(stage: str, source: str, target: str, abnormal: Column) -> Column:
    return F.struct(
        F.lit(stage).alias("stage"),
        F.col(source).alias("input_count"),
        F.col(target).alias("output_count"),
        (F.col(source) - F.col(target)).alias("dropped_count"),
        abnormal.cast("bigint").alias("abnormal_count"),
    )


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Q10: count rows of a stage while it runs, without a second pass."""
    watch = Observation(name)
    return df.observe(watch, F.count(F.lit(1)).alias("rows")), watch


class ObservedRun:
    """Q10: counters of every stage of one write, taken while the rows pass.

    ``watch`` marks a stage; after ``store`` has written the last one, ``counts`` has each stage's numbers.
    A stage may count more than rows; what it counts must be an aggregate.
    """

    def __init__(self):
        self._watches: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        self._watches[stage] = Observation(stage)
        return df.observe(self._watches[stage], F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])

    def store(self, df: DataFrame, path: str) -> DataFrame:
        """Writes the rows, which runs all stages once, and returns the stored table."""
        df.write.mode("errorifexists").parquet(path)
        return df.sparkSession.read.parquet(path)

    def counts(self, stage: str) -> dict[str, int]:
        return {n: v or 0 for n, v in self._watches[stage].get.items()}


def store_counted(raw: DataFrame, path: str, rules: Rules = DEFAULT_RULES) -> tuple[DataFrame, ObservedRun]:
    """Q10: clean, flag and store all reviews in one write that also counts its stages.

    Rejected rows are counted where the dates are parsed, so ``raw`` is read once by the cleaning; the
    duplicate digests alone are grouped beside it.  Returns the stored reviews and the counters.
    """
    from cairn.operators.duplicates import flag_exact_duplicates

    run = ObservedRun()
    good = parse_day(F.col("publish_date")).isNotNull() & strip(F.col("comment_id")).try_cast("bigint").isNotNull()
    rows = run.watch(raw, "read source", rejected=F.count_if(~good))
    clean = run.watch(clean_reviews(rows, rules), "normalise fields")
    usable = (F.col("is_low_info") == 0) & (F.col("is_dup_content") == 0)
    flagged = run.watch(flag_exact_duplicates(cut_lineage(clean), rules), "flags", usable=F.count_if(usable))
    return run.store(flagged, path), run


def observed_steps(spark: SparkSession, run: ObservedRun) -> DataFrame:
    """The counters of ``store_counted`` in the layout of ``step_counters``: four rows."""
    read, clean, flags = (run.counts(s) for s in ("read source", "normalise fields", "flags"))
    steps = [("read source", read["rows"], read["rows"], 0), ("normalise fields", read["rows"], clean["rows"], read["rejected"]),
             ("mark duplicates and short texts", clean["rows"], flags["rows"], 0),
             ("text modelling input", flags["rows"], flags["usable"], 0)]
    return spark.createDataFrame([(s, i, o, i - o, a) for s, i, o, a in steps],
                                 "stage string, input_count bigint, output_count bigint, dropped_count bigint, abnormal_count bigint")
