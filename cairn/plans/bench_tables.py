"""Result tables over the bench data, built lazily from one session and data folder."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.json_body import json_source
from cairn.operators import annotation, cleaning, duplicates, entities, facts, features, statistics
from cairn.sources import sidefiles, star
from cairn.session import cut_lineage, forget
from cairn.sources.star import BENCH_RULES


class BenchTables:
    """Each property is a plan; those that are stored run when they are first used."""

    rules = BENCH_RULES

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return star.table(self.spark, self.sf_dir, name)

    @cached_property
    def raw(self) -> DataFrame:
        return star.raw_reviews(self.spark, self.sf_dir)

    @cached_property
    def raw_with_bad_dates(self) -> DataFrame:
        return star.raw_reviews(self.spark, self.sf_dir, bad_dates=True)

    @cached_property
    def clean(self) -> DataFrame:
        return cleaning.clean_reviews(self.raw, self.rules)

    @cached_property
    def reviews(self) -> DataFrame:
        return duplicates.flag_exact_duplicates(self.clean, self.rules)

    @cached_property
    def line_reviews(self) -> DataFrame:
        return star.line_reviews(self.spark, self.sf_dir, self.rules)

    @cached_property
    def scopes(self) -> DataFrame:
        return sidefiles.scope_labels(star.spot_scopes(self.spark, self.sf_dir))

    @cached_property
    def spots(self) -> DataFrame:
        return entities.build_spots(self.raw, self.scopes, self.rules)

    @cached_property
    def stats(self) -> DataFrame:
        return statistics.spot_statistics(self.clean, self.rules)

    @cached_property
    def line_stats(self) -> DataFrame:
        return statistics.spot_statistics(self.line_reviews, self.rules)

    @cached_property
    def times(self) -> DataFrame:
        return statistics.time_statistics(self.clean, rules=self.rules)

    @cached_property
    def origins(self) -> DataFrame:
        return statistics.origin_statistics(self.clean, self.rules)

    @cached_property
    def layered(self) -> DataFrame:
        return annotation.work_layers(self.reviews, self.rules)

    @cached_property
    def stored(self) -> StoredTables:
        """The same tables with the shared ones stored, for queries that read them several times."""
        return StoredTables(self.spark, self.sf_dir)

    @cached_property
    def stored_layers(self) -> DataFrame:
        """The work layers as a stored table, for queries that read them several times.

        Annotation costs much time and few bytes a row, so the rows are dealt over all shuffle partitions;
        sized by bytes, a small table would be one task.
        """
        rows = self.stored.layered.select("comment_id", "spot_name", "content", "layer", "representative_id", "is_low_info")
        return cut_lineage(rows.repartition(self._partitions(), "comment_id"))

    @cached_property
    def responses(self) -> DataFrame:
        """Stored, as an annotator's answers are: their validation would otherwise repeat the reading."""
        return cut_lineage(annotation.read_responses(self.stored_layers.filter(F.col("layer") == annotation.CALL), self.rules))

    @cached_property
    def results(self) -> DataFrame:
        """Rule, called and reused annotations of every review, stored like the result tables."""
        return cut_lineage(annotation.annotate_all(self.stored_layers, self.responses, "rules", self.rules))

    @cached_property
    def sentiment(self) -> DataFrame:
        return annotation.sentiment_table(self.results, self.rules)

    @cached_property
    def aspects(self) -> DataFrame:
        return annotation.aspect_table(self.results, self.rules)

    @cached_property
    def semantic(self) -> DataFrame:
        return annotation.semantic_table(self.results)

    @cached_property
    def partial_sentiment(self) -> DataFrame:
        """The result table of a run that ended after the rule layer."""
        return self.sentiment.filter(json_source(F.col("raw_json")) == annotation.RULE)

    @cached_property
    def packages(self) -> DataFrame:
        t = self.stored
        return facts.fact_packages(t.spots, t.stats, self.sentiment, self.aspects, t.reviews,
                                   self.rules, F.lit("2024-01-01 00:00:00"))

    @cached_property
    def reports(self) -> DataFrame:
        """Stored reports: entities introduced by a building or furniture have none, every fifth has an old version."""
        number = F.substring("spot_name", 4, 10).cast("int")
        lists = {n: F.to_json(F.array(F.col("source_scope"), F.lit(n))).alias(f"{n}_json")
                 for n in ("advantages", "issues", "visitor_focus")}
        without = F.coalesce(F.col("introduction").rlike("^(BUILDING|FURNITURE)"), F.lit(False))
        return self.spots.filter(~without).select(
            "spot_name", F.when(number % 5 == 0, "v0").otherwise(self.rules.package_version).alias("fact_package_version"),
            F.concat(F.lit("共 "), F.col("review_count").cast("string"), F.lit(" 条评论")).alias("summary"),
            *lists.values(), F.lit("stub").alias("model"), F.lit("p1").alias("prompt_version"),
            (number % 2).alias("need_review"), F.lit(0).cast("bigint").alias("token_usage"))

    @cached_property
    def pairs(self) -> DataFrame:
        """Requested comparisons: every entity with its successor, and one pair with itself."""
        number = F.substring("spot_name", 4, 10).cast("int")
        other = F.concat(F.lit("src"), F.when(number == 3, 3).otherwise((number + 1) % 20).cast("string"))
        return self.scopes.select(F.col("spot_name").alias("spot_a"), other.alias("spot_b"))

    @cached_property
    def questions(self) -> DataFrame:
        return star.questions(self.spark, self.sf_dir)

    @cached_property
    def features(self) -> DataFrame:
        return self._features_of(self.reviews)

    @cached_property
    def stored_features(self) -> DataFrame:
        """What the models read of the features, stored because they read it several times.

        The rows lie by ``comment_id``, so the terms of a row are counted, and meet its label, where they are;
        the texts are dealt out before they become tokens.
        """
        rows = cut_lineage(self.reviews.select("comment_id", "spot_name", "score", "content", "is_low_info", "is_dup_content"))
        dealt = self._features_of(rows.repartition(self._partitions(), "comment_id"))
        out = cut_lineage(dealt.drop("tokens"), keep_partitioning=True)
        forget(rows)
        return out

    @staticmethod
    def _features_of(reviews: DataFrame) -> DataFrame:
        return features.modelling_input(reviews, stop_words=("the", "of", "and", "le", "la", "der", "die"))

    def _partitions(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))


class StoredTables(BenchTables):
    """Bench tables whose shared steps are written once, so that no later plan repeats them."""

    @property
    def stored(self) -> StoredTables:
        return self

    @cached_property
    def clean(self) -> DataFrame:
        return cut_lineage(super().clean)

    @cached_property
    def reviews(self) -> DataFrame:
        return cut_lineage(super().reviews)

    @cached_property
    def spots(self) -> DataFrame:
        return cut_lineage(super().spots)

    @cached_property
    def stats(self) -> DataFrame:
        return cut_lineage(super().stats)

    @cached_property
    def questions(self) -> DataFrame:
        return cut_lineage(super().questions)
