"""Statistics kept by increments (K1, K3 with A1-A6).

A state row holds the sums of one (entity, day, region): every measure of the entity, time and origin
statistics is a sum over such rows or the range of their days, so a replaced or removed review is taken out
again by subtraction, dates included.  A batch of reviews is reduced to state rows first; only those are
merged, and the state has a row for each entity, day and region, however many reviews there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import rates
from cairn.operators import statistics
from cairn.rules import DEFAULT_RULES, Rules
from cairn.session import cut_lineage, path_exists
from cairn.sinks.tables import KeyedTable, latest

KEYS = ("spot_name", "publish_date", "region")
SUMS = ("reviews", "score_sum", "scored", *(f"score_{s}" for s in statistics.SCORES), "with_image", "likes", "low_info", "valid_ip")
#: What a review contributes by.
READ = ("comment_id", "spot_name", "publish_date", "ip_province", "score", "image_count", "like_count", "is_low_info")


def state_rows(reviews: DataFrame, sign: int = 1) -> DataFrame:
    """Sums of a batch by entity, day and region, added (sign 1) or taken out (-1)."""
    score = F.col("score")
    valid = F.coalesce(statistics.valid_region(), F.lit(False))
    measures = {
        "reviews": F.count(F.lit(1)), "score_sum": F.coalesce(F.sum("score"), F.lit(0)), "scored": F.count("score"),
        **{f"score_{s}": F.count_if(score == s) for s in statistics.SCORES},
        "with_image": F.count_if(F.col("image_count") > 0), "likes": F.coalesce(F.sum("like_count"), F.lit(0)),
        "low_info": F.count_if(F.col("is_low_info") == 1), "valid_ip": F.count_if(valid)}
    region = F.when(valid, F.col("ip_province"))
    return reviews.groupBy("spot_name", "publish_date", region.alias("region")).agg(
        *[(F.lit(sign) * m).cast("bigint").alias(n) for n, m in measures.items()])


def merged(*parts: DataFrame) -> DataFrame:
    """One state of several.  A row without reviews may still change sums, until ``settled``."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


def settled(state: DataFrame) -> DataFrame:
    """A whole state without the rows whose reviews were all taken out again."""
    return state.filter(F.col("reviews") != 0)


def delta(stored: DataFrame, new: DataFrame) -> DataFrame:
    """State rows that a batch changes: its reviews, one of each id, added, the stored ones of these ids taken out."""
    old = stored.select(*READ).join(new.select("comment_id"), "comment_id", "left_semi")
    return merged(state_rows(new), state_rows(old, -1))


def spot_statistics(state: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A1, A2 from a state: equal to ``statistics.spot_statistics`` of the reviews behind it."""
    total, scored, scores = F.sum("reviews"), F.sum("scored"), [f"score_{s}" for s in statistics.SCORES]
    return state.groupBy("spot_name").agg(
        total.alias("review_count"), rates.ratio(F.sum("score_sum"), scored, 2).alias("avg_score"),
        *[F.sum(c).alias(c) for c in scores],
        rates.ratio(F.sum(F.col("score_4") + F.col("score_5")), scored).alias("positive_rate"),
        rates.ratio(F.sum(F.col("score_1") + F.col("score_2")), scored).alias("negative_rate"),
        rates.ratio_or_zero(F.sum("with_image"), total).alias("image_rate"), F.sum("likes").alias("total_likes"),
        rates.ratio_or_zero(F.sum("low_info"), total).alias("low_info_rate"), F.sum("valid_ip").alias("valid_ip_sample"),
        F.min("publish_date").alias("first_comment_date"), F.max("publish_date").alias("last_comment_date"),
    ).withColumn("stat_version", F.lit(rules.stat_version))


def _as_reviews(state: DataFrame) -> DataFrame:
    return state.filter(F.col("publish_date").isNotNull())


def time_statistics(state: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A3, A4 from a state."""
    day = F.col("publish_date")
    year, month = F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM")
    levels = F.array(*[
        F.struct(F.lit(kind).alias("period_type"), period.alias("period"), F.lit(scope).alias("scope_type"), name.alias("spot_name"))
        for kind, period, scope, name in (("year", year, "global", F.lit(None).cast("string")), ("month", month, "global", F.lit(None).cast("string")),
                                          ("year", year, "spot", F.col("spot_name")))])
    # First by entity and month, so that the levels roll up a small table.
    monthly = _as_reviews(state).groupBy("spot_name", F.trunc("publish_date", "month").alias("publish_date")).agg(
        *[F.sum(c).alias(c) for c in ("reviews", "score_sum", "scored")])
    return monthly.select(F.explode(levels).alias("l"), "reviews", "score_sum", "scored").groupBy("l").agg(
        F.sum("reviews").alias("review_count"), rates.ratio(F.sum("score_sum"), F.sum("scored"), 2).alias("avg_score")).select(
        "l.*", "review_count", "avg_score", F.lit(None).cast("double").alias("sentiment_avg"), F.lit(rules.stat_version).alias("stat_version"))


def origin_statistics(state: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """A5, A6 from a state."""
    regions = state.filter(F.col("region").isNotNull()).groupBy("spot_name", "region").agg(F.sum("reviews").alias("n"))
    scopes = F.array(F.struct(F.lit("global").alias("scope_type"), F.lit(None).cast("string").alias("spot_name")),
                     F.struct(F.lit("spot").alias("scope_type"), F.col("spot_name").alias("spot_name")))
    rows = regions.select(F.explode(scopes).alias("s"), "region", "n").groupBy("s", "region").agg(F.sum("n").alias("review_count"))
    totals = rows.groupBy("s").agg(F.sum("review_count").alias("sample_size"))
    return rows.join(totals, "s").select(
        "s.*", F.col("region").alias("ip_province"), "review_count", rates.ratio_or_zero(F.col("review_count"), F.col("sample_size")).alias("ratio"),
        "sample_size", statistics.overseas(F.col("region"), rules).alias("is_overseas"), F.lit(rules.stat_version).alias("stat_version"))


class IncrementalStatistics:
    """Stored reviews and their state, kept together under one folder.

    A batch is written in three steps: the changed state rows (a delta named by its batch), the reviews, and
    the mark that the batch is complete.  ``state`` reads the deltas of complete batches alone, so a run that
    dies half-way leaves the old statistics, and a batch that is applied again after its mark changes nothing.
    ``compact`` folds all deltas into one.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        self.reviews = KeyedTable(spark, f"{self.path}/reviews", ["comment_id"], "written", buckets)

    def _marks(self) -> DataFrame:
        """(batch, folds): complete batches, and up to which batch a compacted one holds all others."""
        return self.spark.read.schema("batch bigint, folds bigint").parquet(f"{self.path}/marks")

    def _exists(self) -> bool:
        return path_exists(self.spark, f"{self.path}/marks")

    def _mark(self, batch: int, folds: int) -> None:
        self.spark.createDataFrame([(batch, folds)], "batch bigint, folds bigint").write.mode("append").parquet(f"{self.path}/marks")

    def _complete(self) -> list[int]:
        """Batches that the state consists of: the last compacted one and those after it."""
        marks = self._marks().collect() if self._exists() else []  # a row for each batch
        base = max((m.folds for m in marks), default=-1)
        return sorted(m.batch for m in marks if m.folds == base >= 0 or m.folds < 0 and m.batch > base)

    def state(self) -> DataFrame:
        batches = self._complete()
        if not batches:
            raise ValueError("no batch was applied yet")
        return settled(merged(self.spark.read.parquet(*[f"{self.path}/state/batch={b}" for b in batches])))

    def apply(self, incoming: DataFrame, batch: int) -> None:
        """Merges a batch of reviews (READ columns and ``written``); batches are numbered 0, 1, ... upwards.

        Of several rows of one id the last ``written`` counts, in the batch and against what is stored.
        """
        first = not self._exists()
        if not first and not self._marks().filter((F.col("batch") == batch) | (F.col("folds") >= batch)).isEmpty():
            return
        rows = cut_lineage(latest(incoming.select(*READ, "written"), ["comment_id"], "written"))
        stored = rows.filter("false") if first else self.reviews.read()
        # A run that died before its mark may have stored its reviews already; then its own delta counts.
        if not path_exists(self.spark, f"{self.path}/state/batch={batch}/_SUCCESS"):
            delta(stored, rows).write.mode("overwrite").parquet(f"{self.path}/state/batch={batch}")
        if first and not path_exists(self.spark, f"{self.path}/reviews/_SUCCESS"):
            self.reviews.create(rows)
        else:
            self.reviews.merge(rows)
        self._mark(batch, -1)

    def compact(self) -> None:
        """All complete batches as one, so that reading the state does not grow with their number."""
        batches = self._complete()
        last = max(batches)
        folded = 1_000_000_000 + last  # a number of its own
        self.state().write.mode("overwrite").parquet(f"{self.path}/state/batch={folded}")
        self._mark(folded, last)
