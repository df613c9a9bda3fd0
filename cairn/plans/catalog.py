"""Every operator as a runnable query over the bench tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.json_body import json_mode, json_source, usage_tokens
from cairn.operators import (
    annotation, baseline, cleaning, compare, costs, duplicates, entities, facts, features, increments, linking,
    numbering, numbers, opinions, quality, questions, segmentation, statistics, topics, validation,
)
from cairn.plans import views
from cairn.plans.bench_tables import BenchTables
from cairn.rules import caliber_notes
from cairn.session import cut_lineage, ensure_checkpoint_dir
from cairn.sinks import files, tables as sinks
from cairn.sinks.models import ModelStore
from cairn.schema import CLEANED_CSV_SCHEMA
from cairn.sources import gates, queries as table_queries, reviews as review_sources, sampling, sidefiles, star

Query = Callable[[BenchTables], DataFrame]
_REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        return lambda spark, sf_dir: fn(BenchTables(spark, sf_dir))

    return {name: bind(fn) for name, fn in _REGISTRY.items()}


# --- volume statistics over line items (A1-A6, A16, L1) -----------------------------------------

@register
def line_spot_statistics(t):  # A1 A2
    return t.line_stats


@register
def line_time_statistics(t):  # A3 A4 U1 P16, with entity by month switched on
    return statistics.time_statistics(t.line_reviews, spot_months=True, rules=t.rules).drop("sentiment_avg", "stat_version")


@register
def line_origin_statistics(t):  # A5 A6 W2 F1 P10
    return statistics.origin_statistics(t.line_reviews, t.rules).drop("stat_version")


@register
def line_ranking(t):  # L1 F5 with the rates at work
    return line_ranking_of(t)


def line_ranking_of(t: BenchTables, limit: int = 20) -> DataFrame:
    """The flagship query: entity statistics, then the best positive rates with a minimum sample."""
    names = t.table("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("spot_name"),
        F.when(F.col("s_nationkey") % 3 == 0, "route").otherwise("tibet").alias("source_scope"),
        F.lit(1).alias("has_full_evaluation"))
    return views.ranking(names, t.line_stats, "positive_rate", limit, t.rules)


@register
def line_volume_buckets(t):  # A16
    return statistics.volume_buckets(t.line_stats, (("650+", 650), ("600-649", 600)), "under 600")


@register
def line_totals(t):  # A7
    return statistics.dataset_totals(t.line_reviews)


# --- cleaning (P1-P15, A8-A12, S6, S7, S13, S14, Q10) --------------------------------------------

@register
def clean_reviews(t):  # P1-P14
    return t.clean.withColumn("content", F.md5("content"))


@register
def rejected_reviews(t):  # P7
    return cleaning.split_by_date(t.raw_with_bad_dates)[1].select("comment_id", "publish_date")


@register
def cleaning_steps(t):  # Q10 P28
    return cleaning.step_counters(t.raw_with_bad_dates, t.rules).drop("detail_json")


@register
def normalisation_statistics(t):  # A12
    return cleaning.normalisation_statistics(t.clean)


@register
def layering_statistics(t):  # A11
    return cleaning.layering_statistics(t.reviews)


@register
def duplicate_groups(t):  # A33
    return duplicates.duplicate_groups(t.clean).select("dup_group_id", "members")


@register
def duplicate_flags(t):  # P12 A33
    return t.reviews.select("comment_id", "is_dup_content", "dup_group_id")


@register
def listed_duplicate_flags(t):  # S7 P12
    members = sidefiles.duplicate_members(star.listed_duplicates(t.spark, t.sf_dir))
    return duplicates.flag_listed_duplicates(t.clean, members).select("comment_id", "is_dup_content", "dup_group_id")


@register
def duplicate_representatives(t):  # W1
    return duplicates.representatives(t.reviews).drop("members")


@register
def group_members(t):  # J9
    rows = duplicates.with_representative(t.reviews, t.rules)
    return rows.filter(F.col("representative_id").isNotNull() & (F.col("comment_id") != F.col("representative_id"))).select(
        "comment_id", "dup_group_id", "representative_id")


@register
def flag_overlap(t):  # A32
    return duplicates.flag_overlap(t.reviews)


@register
def spot_dimension(t):  # A8 A9 A10 P5 P6
    return t.spots


@register
def representative_values(t):  # A8
    return entities.representative_values(t.raw).select("spot_name", "field", F.md5("value").alias("value_md5"), "occurrences")


@register
def phone_truncations(t):  # A9
    return entities.phone_truncations(t.raw, t.rules)


@register
def spot_counters(t):  # A10
    return entities.spot_counters(t.spots)


@register
def scope_labels(t):  # S6
    return t.scopes


@register
def entity_level_counts(t):  # S14
    return gates.entity_level_counts(t.spots)


@register
def unknown_entities(t):  # S13 U3
    return gates.unknown_entities(t.clean, t.spots.filter(F.col("source_scope") == "tibet"))


@register
def reviews_with_spot_fields(t):  # P15
    return entities.with_spot_fields(t.clean, t.spots).select("comment_id", "address", "open_time", "introduction")


@register
def reviews_with_spot_id(t):  # J2
    ids = t.scopes.select("spot_name", F.substring("spot_name", 4, 10).cast("int").alias("spot_id"))
    return entities.attach_spot_id(t.clean, ids).select("comment_id", "spot_id")


# --- statistics over reviews ---------------------------------------------------------------------

@register
def spot_statistics(t):  # A1 A2 P19
    return t.stats


@register
def time_statistics(t):  # A3 A4
    return t.times.drop("sentiment_avg", "stat_version")


@register
def origin_statistics(t):  # A5 A6 P9
    return t.origins.drop("stat_version")


@register
def dataset_totals(t):  # A7
    return statistics.dataset_totals(t.clean)


@register
def score_distribution(t):  # A14
    return statistics.score_distribution(t.clean)


@register
def volume_buckets(t):  # A16
    return statistics.volume_buckets(t.stats)


@register
def scope_composition(t):  # A17 P21
    return statistics.scope_composition(t.spots, t.clean)


@register
def weak_labels(t):  # P17 P18
    label = statistics.weak_label(F.col("score"))
    rows = t.clean.filter(F.col("score").isNotNull())
    return rows.groupBy(label.alias("label"), statistics.polarity_name(label).alias("polarity")).agg(F.count(F.lit(1)).alias("n"))


# --- views ------------------------------------------------------------------------------------------

@register
def overview_totals(t):  # A13
    return views.overview_totals(t.reviews, t.spots)


@register
def data_note(t):  # Q13
    return views.data_note(t.reviews, t.spots)


@register
def yearly_trend(t):  # L4
    return views.trend(t.times, "year").drop("sentiment_avg")


@register
def monthly_trend(t):  # L4
    return views.trend(t.times, "month").drop("sentiment_avg")


@register
def spot_trend(t):  # L4
    return views.trend(t.times, "year", spot="src7").drop("sentiment_avg")


@register
def top_origins(t):  # L2
    return views.top_origins(t.origins, 10)


@register
def origin_summary(t):  # A31
    return views.origin_summary(t.origins)


@register
def spot_page(t):  # L3 F4 J4
    return views.spot_list(t.spots, t.stats, keyword="src1", page=2, page_size=4)


@register
def page_totals(t):  # L3
    return views.page_totals(t.spots, "src1")


@register
def ranking_by_reviews(t):  # L1 J5
    return views.ranking(t.spots, t.stats, "reviews", 7, t.rules)


@register
def ranking_by_rating(t):  # L1
    return views.ranking(t.spots, t.stats, "rating", 7, t.rules)


@register
def spot_details(t):  # P22 P23 P27
    return views.spot_details(t.spots, t.stats, t.rules)


# --- annotation ------------------------------------------------------------------------------------

@register
def work_layers(t):  # M1
    return t.layered.select("comment_id", "layer", "representative_id")


@register
def pending_work(t):  # M2 J6
    return annotation.pending_work(t.layered, t.partial_sentiment, t.rules).select("comment_id", "layer")


@register
def layer_totals(t):  # U5 Q5
    return annotation.layer_totals(t.layered, t.partial_sentiment, t.rules)


@register
def rule_labels(t):  # M3, run over every text
    return annotation.rule_labels(t.clean, t.rules).withColumn("summary", F.md5("summary"))


@register
def read_annotations(t):  # M4
    fields = F.from_json("raw_text", "polarity string, intensity int, aspects array<struct<aspect:string,evidence:string>>")
    return annotation.read_responses(t.clean, t.rules).select(
        "comment_id", fields["polarity"].alias("polarity"), fields["intensity"].alias("intensity"),
        F.array_join(F.transform(fields["aspects"], lambda a: F.concat(a["aspect"], F.lit(":"), a["evidence"])), ",").alias("aspects"))


@register
def validated_annotations(t):  # M6 M7 M8 M9 P24
    rows = validation.validate_annotations(star.annotator_responses(t.clean), t.rules)
    return rows.select(
        "comment_id", F.col("is_usable").cast("int").alias("is_usable"), "polarity", "intensity", "is_valid",
        F.array_join(F.transform("aspects", lambda a: a["aspect"]), ",").alias("accepted"),
        F.array_join(F.transform("dropped_aspects", lambda a: a["reason"]), ",").alias("reasons"),
        F.md5("keywords").alias("keywords_md5"), F.md5("summary").alias("summary_md5"))


@register
def dropped_aspects(t):  # M8
    rows = validation.validate_annotations(star.annotator_responses(t.clean), t.rules)
    return rows.select(F.explode_outer("dropped_aspects").alias("d")).filter(F.col("d").isNotNull()).groupBy("d.reason").agg(F.count(F.lit(1)).alias("n"))


@register
def sentiment_rows(t):  # M10 M11 P26
    raw = F.col("raw_json")
    return t.sentiment.select("comment_id", "spot_name", "polarity", "intensity", "is_valid",
                              json_source(raw).alias("source"), json_mode(raw).alias("mode"),
                              (usage_tokens(raw) > 0).alias("has_usage"))


@register
def aspect_rows(t):  # M10 J10
    return t.aspects.select("comment_id", "spot_name", "aspect_name", "polarity", F.md5("evidence").alias("evidence_md5"))


@register
def semantic_rows(t):  # M10
    return t.semantic.select("comment_id", "spot_name", F.md5("keywords").alias("keywords_md5"),
                             F.md5("summary").alias("summary_md5"), "source")


@register
def reused_results(t):  # M11 J10
    first = annotation.annotated_rows(t.responses, "rules", t.rules)
    return annotation.reuse_rows(t.stored_layers, first, t.rules).select(
        "comment_id", "spot_name", "polarity", "intensity",
        F.get_json_object("raw_json", "$.reused_from_comment_id").cast("bigint").alias("reused_from"))


def shouting_annotator():
    """Answers with the word count; a text without a small letter is refused."""
    def annotate(texts):
        words = texts.fillna("").str.split().str.len()
        refused = texts.fillna("").str.upper() == texts.fillna("")
        return [ValueError("no small letter") if bad else
                {"raw_text": str(n), "prompt_tokens": n, "completion_tokens": 1, "total_tokens": n + 1}
                for n, bad in zip(words.tolist(), refused.tolist())]

    return annotate


@register
def annotator_job(t):  # M5
    return annotation.run_annotator(t.clean, shouting_annotator()).select(
        "comment_id", "attempt", "error_kind", F.length("error_reason").alias("reason_length"),
        (F.col("total_tokens") > 1).alias("has_tokens"))


@register
def annotator_failures(t):  # M12
    return annotation.failure_rows(annotation.run_annotator(t.clean, shouting_annotator()))


@register
def merged_calls(t):  # M13 A30
    return annotation.merge_calls(star.call_log(t.spark, t.sf_dir)).withColumn("raw_text", F.md5("raw_text"))


@register
def call_statistics(t):  # A29
    return annotation.call_statistics(star.call_log(t.spark, t.sf_dir))


@register
def sentiment_distribution(t):  # A18
    return opinions.sentiment_distribution(t.sentiment, rules=t.rules)


@register
def method_coverage(t):  # A15
    return statistics.method_coverage(t.sentiment)


@register
def aspect_statistics(t):  # A19
    return opinions.aspect_statistics(t.aspects, rules=t.rules).drop("note")


@register
def focus_ranking(t):  # A20
    return opinions.focus_ranking(t.aspects, rules=t.rules)


@register
def keyword_frequency(t):  # A21
    return opinions.keyword_frequency(t.semantic)


@register
def most_negative_aspects(t):  # A22 F6
    return opinions.most_negative_aspects(t.aspects, rules=t.rules)


@register
def length_histogram(t):  # A24
    return costs.length_histogram(t.layered.filter(F.col("layer") == "call"))


@register
def usage_range(t):  # A25 P26
    return costs.usage_range(t.sentiment, t.rules)


@register
def cost_projection(t):  # A26 A27
    pending = annotation.pending_work(t.layered, t.partial_sentiment, t.rules).filter(F.col("layer") == "call")
    waiting = t.spots.filter(F.col("has_full_evaluation") == 1).join(t.reports, "spot_name", "left_anti")
    return costs.cost_projection(pending, waiting, t.rules)


@register
def evidence_violations(t):  # J14 Q4: aspect rows whose evidence was bent by review id
    bent = t.aspects.withColumn("evidence", F.when(F.col("comment_id") % 5 == 0, F.translate("evidence", " \n", ""))
                                .when(F.col("comment_id") % 7 == 0, F.concat("evidence", F.lit("#")))
                                .otherwise(F.col("evidence")))
    return validation.evidence_violations(bent, t.reviews).select("comment_id", "aspect_name", "violation")


# --- facts and reports -------------------------------------------------------------------------------

@register
def representative_reviews(t):  # R2 L7 W4
    return facts.representative_reviews(t.reviews, t.rules).withColumn("content", F.md5("content"))


@register
def review_voices(t):  # R10 J17
    return facts.voices(t.reviews, t.aspects, rules=t.rules).select(
        "spot_name", "voice", "rank_no", "comment_id", F.array_join("topics", ",").alias("topics"))


@register
def usable_voices(t):  # F7
    return facts.voices(t.reviews, t.aspects, limit=3, skip_low_info=True, rules=t.rules).select(
        "spot_name", "voice", "rank_no", "comment_id")


@register
def fact_packages(t):  # R1
    p = F.col("package")
    return t.packages.select(
        "spot_name", "version", "review_count", p["basic"]["source_scope"].alias("source_scope"),
        p["basic"]["intro_excerpt"].alias("intro_excerpt"), p["statistics"]["avg_score"].alias("avg_score"),
        p["statistics"]["time_range"]["last"].alias("last_date"), p["sentiment"]["sample_size"].alias("sentiment_sample"),
        p["sentiment"]["positive"].alias("sentiment_positive"),
        F.size(p["aspects"]).alias("aspects"), p["aspects"][0]["aspect"].alias("first_aspect"),
        p["aspects"][0]["negative_rate"].alias("first_aspect_negative"),
        F.size(p["representative_reviews"]["positive"]).alias("positive_reviews"),
        p["representative_reviews"]["positive"][0]["comment_id"].alias("first_positive"))


@register
def package_statistics(t):  # R4
    return facts.package_statistics(t.packages)


@register
def missing_packages(t):  # R3
    existing = t.spots.filter(F.col("source_scope") == "route").select("spot_name", F.lit("v1").alias("version"))
    return facts.missing_packages(t.packages, existing).select("spot_name", "version")


@register
def allowed_numbers(t):  # R7
    rows = facts.allowed_numbers(t.packages)
    return rows.select(
        "spot_name", F.size("percent_facts").alias("percents"), F.size("plain_facts").alias("numbers"),
        F.round(F.aggregate("percent_facts", F.lit(0.0), lambda a, x: a + x), 2).alias("percent_sum"),
        F.round(F.aggregate("plain_facts", F.lit(0.0), lambda a, x: a + x), 2).alias("number_sum"))


@register
def stale_reports(t):  # R8
    return facts.stale_reports(t.packages, t.reports)


@register
def report_view(t):  # R9 W5 P23 P25
    stored = facts.package_table(t.packages)
    older = stored.withColumns({"version": F.lit("v0"), "generated_at": F.lit("2023-01-01 00:00:00")})
    view = facts.report_view(t.spots, t.stats, stored.unionByName(older), t.reports, t.rules)
    return view.withColumns({c: F.array_join(c, ",") for c in ("advantages", "issues", "visitor_focus", "top_aspects")})


@register
def validated_reports(t):  # R5
    rows = validation.validate_reports(star.report_responses(t.line_stats))
    return rows.select(
        "spot_name", F.col("is_usable").cast("int").alias("is_usable"), F.length("summary").alias("summary_length"),
        F.size("advantages").alias("advantages"), F.size("issues").alias("issues"),
        F.size("visitor_focus").alias("visitor_focus"), F.array_join("repairs", ",").alias("repairs"))


@register
def report_number_check(t):  # R6
    allowed = t.line_stats.select(
        "spot_name", numbers.percent_facts(F.col("positive_rate"), F.col("negative_rate"), F.col("image_rate")).alias("percent_facts"),
        F.array(F.col("review_count").cast("double"), F.col("avg_score"), F.col("total_likes").cast("double")).alias("plain_facts"))
    rows = validation.validate_reports(star.report_responses(t.line_stats)).join(allowed, "spot_name")
    return numbers.check_report_numbers(rows).select(
        "spot_name", F.size("percent_mismatches").alias("wrong_percents"),
        F.size("number_mismatches").alias("wrong_numbers"), "need_review")


@register
def packages_by_id(t):  # F8: the entities of a list, here those that have a report
    return facts.of_entities(t.packages, t.reports.select("spot_name")).select("spot_name", "version", "review_count")


@register
def packages_by_version(t):  # F9
    stored = facts.package_table(t.packages)
    older = stored.withColumn("version", F.lit("v0"))
    return facts.of_version(stored.unionByName(older), t.rules.package_version).select("spot_name", "version", "review_count")


@register
def outside_reuse(t):  # J8: rows that no reuse row stands for
    reused = t.layered.filter(F.col("layer") == annotation.REUSE).select("representative_id")
    return annotation.not_in(t.layered.select("comment_id", "layer"), reused, "comment_id", "representative_id")


@register
def run_report_top(t):  # L6: the five entities with most reviews
    return views.ranking(t.spots, t.stats, "reviews", 5, t.rules).select("spot_name", "review_count", "avg_score")


# --- comparison --------------------------------------------------------------------------------------

@register
def pair_differences(t):  # C1 C2
    return compare.pair_differences(t.pairs, compare.snapshots(t.spots, t.stats, t.sentiment, t.rules))


@register
def indicator_rows(t):  # C4
    return compare.indicator_rows(t.pairs, compare.snapshots(t.spots, t.stats, t.sentiment, t.rules))


@register
def aspect_alignment(t):  # C3 J12
    return compare.aspect_alignment(t.pairs, t.aspects, rules=t.rules)


@register
def validated_comparisons(t):  # C5 C6
    rows = validation.validate_comparisons(star.comparison_responses(t.spark, t.sf_dir))
    return rows.select("pair_id", F.col("is_usable").cast("int").alias("is_usable"),
                       F.size("differences").alias("differences"), F.size("possible_reasons").alias("reasons"),
                       F.array_join("verdict_words", ",").alias("verdict_words"))


@register
def comparison_numbers(t):  # C7
    rows = star.comparison_responses(t.spark, t.sf_dir)
    return rows.select("pair_id", F.array_join(numbers.unmatched_tokens(F.col("text"), F.col("facts")), ";").alias("unmatched"))


# --- questions ---------------------------------------------------------------------------------------

def _spot_items(t: BenchTables) -> DataFrame:
    return questions.spot_fact_items(t.stats, t.reports, t.sentiment, t.aspects, t.semantic, t.rules)


def _global_items(t: BenchTables) -> DataFrame:
    return questions.metric_items(t.reviews, t.spots, t.origins).unionByName(questions.ranking_items(t.stats, t.rules))


def _retrieved(t: BenchTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions and entity items are read several times below, so both are stored first."""
    t = t.stored
    classified = cut_lineage(questions.classify(t.questions))
    linked = cut_lineage(linking.link_entities(t.questions, t.spots))
    items, shared = cut_lineage(_spot_items(t)), cut_lineage(_global_items(t))
    return classified, linked, questions.retrieve(classified, linked, items, shared, t.rules)


@register
def question_types(t):  # N1
    return questions.classify(t.questions).select("question_id", "question_type")


@register
def ranking_sizes(t):  # L5
    rows = questions.classify(t.questions).filter(F.col("question_type") == "RANKING")
    return rows.select("question_id", questions.ranking_size(F.col("text")).alias("top_n"))


@register
def mention_candidates(t):  # J15 N4
    return linking.mention_candidates(t.questions, t.spots).select("question_id", "token", "is_whole")


@register
def linked_entities(t):  # N4 W6
    return linking.link_entities(t.questions, t.spots)


@register
def metric_items(t):  # A23 N2
    return questions.metric_items(t.reviews, t.spots, t.origins).select("block_no", "item_no", "item")


@register
def ranking_items(t):  # N2 L6 W3
    return questions.ranking_items(t.stats, t.rules).select("item_no", "item")


@register
def question_facts(t):  # N2
    _, _, found = _retrieved(t)
    return found.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum(F.length("item")).alias("chars"))


@register
def question_context(t):  # N3 L8
    _, _, found = _retrieved(t)
    return questions.context_budget(found, max_items=6, max_chars=260).select(
        "question_id", "position", "used_chars")


@register
def question_branches(t):  # N5 N7
    return questions.decide_branch(*_retrieved(t))


@register
def validated_answers(t):  # N6 C5
    rows = numbers.validate_answers(star.answers(t.spark, t.sf_dir))
    return rows.select("question_id", F.length("checked_answer").alias("answer_length"),
                       F.array_join("boundary_words", ",").alias("boundary_words"), "need_review")


@register
def quotable_numbers(t):  # N6
    classified, _, found = _retrieved(t)
    rows = questions.quotable_numbers(questions.context_budget(found), classified, t.rules)
    return rows.select("question_id", F.size("facts").alias("numbers"))


# --- quality -------------------------------------------------------------------------------------------

@register
def self_check(t):  # Q1 J16
    return quality.self_check(t.clean, t.spots, t.stats, t.origins)


@register
def import_measures(t):  # Q2
    return quality.import_measures(t.reviews, t.spots, t.rules)


def _damaged(t: BenchTables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Annotation tables of a faulty run: no reused results, negative rows with an impossible
    intensity and stored twice in the aspects, no summary rows without keywords."""
    negative = F.col("polarity") == "negative"
    sentiment = t.sentiment.filter(json_source(F.col("raw_json")) != annotation.REUSE).withColumn(
        "intensity", F.when(negative, 7).otherwise(F.col("intensity")))
    aspects = t.aspects.unionByName(t.aspects.filter(negative))
    return sentiment, aspects, t.semantic.filter(F.col("keywords").isNotNull())


@register
def integrity_checks(t):  # Q3 Q4 J13 Q14
    return quality.integrity(*_damaged(t), t.reviews, t.spots, t.rules)


@register
def layer_checks(t):  # Q5 U5
    return quality.layer_checks(t.stored_layers, t.partial_sentiment, t.semantic, t.rules)


@register
def readiness(t):  # Q6
    sentiment, aspects, semantic = _damaged(t)
    checks = quality.integrity(sentiment, aspects, semantic, t.stored.reviews, t.stored.spots, t.rules).unionByName(
        quality.layer_checks(t.stored_layers, sentiment, semantic, t.rules)).unionByName(
        quality.open_failures(star.task_logs(t.spark, t.sf_dir), "error"))
    return quality.verdict(checks).select(
        "status", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"))


@register
def table_fingerprint(t):  # Q7
    return quality.fingerprint(t.clean)


@register
def recomputed_columns(t):  # Q8: the cleaned rows against a derivation that measures texts in bytes
    other = t.clean.withColumn("content_length", F.coalesce(F.octet_length("content"), F.lit(0)))
    return quality.recompute_mismatches(
        other, t.clean, "comment_id", ["score", "content_length", "publish_date", "ip_province", "is_low_info", "like_count"])


@register
def stage_reconciliation(t):  # Q9
    return quality.cross_stage(t.layered)


@register
def count_mismatches(t):  # J16
    return quality.stat_mismatches(t.clean.filter(F.col("score").isNotNull()), t.stats)


@register
def annotation_status(t):  # Q14
    return quality.annotation_status(t.sentiment, t.semantic)


@register
def task_summary(t):  # A28
    return views.task_summary(star.tasks(t.spark, t.sf_dir))


@register
def task_list(t):  # Q11
    return views.task_list(star.tasks(t.spark, t.sf_dir), 15, "error").select("task_id", "task_type", "status", "success_count")


@register
def task_details(t):  # Q11 P25
    return views.task_details(star.task_logs(t.spark, t.sf_dir))


@register
def caliber_table(t):  # Q12 BR-10
    return views.caliber_table(t.clean, t.rules).select("key", "value", "sample_size")


@register
def ranking_with_caliber(t):  # BR-10
    return views.with_caliber(views.ranking(t.spots, t.stats, "reviews", 5, t.rules),
                              caliber_notes(t.rules)["threshold"], "review_count").select("spot_name", "caliber_sample")


# --- sources, sinks -------------------------------------------------------------------------------------

@register
def table_counts(t):  # S16
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
             "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
    return table_queries.table_counts({n: t.table(n) for n in names})


@register
def bound_query(t):  # S15
    return table_queries.query(
        t.spark, "SELECT spot_name, count(*) AS n FROM {reviews} WHERE score >= :least GROUP BY spot_name",
        {"least": 4}, reviews=t.clean)


@register
def hash_sample(t):  # S10
    return sampling.hash_sample(t.clean, 0.2, "comment_id", t.rules.seed).select("comment_id")


@register
def exact_sample(t):  # S10 with its cap
    return sampling.exact_sample(t.clean, 137, "comment_id", t.rules.seed).select("comment_id", "spot_name")


@register
def exact_line_sample(t):  # S10 over line items, more rows than one class of digests holds
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("line"))
    return sampling.exact_sample(lines, 20_000, "line", t.rules.seed)


@register
def first_reviews(t):  # S11
    return sampling.first_rows(t.clean, 50, "comment_id").select("comment_id", "spot_name")


@register
def upserted_sentiment(t):  # K1: every result twice, of which the newer wins, over the rule results
    old = t.partial_sentiment.select("comment_id", F.lit("old").alias("polarity"), F.lit(0).alias("written"))
    new = t.sentiment.filter(F.col("intensity").isNotNull())
    twice = new.select("comment_id", F.lit("first").alias("polarity"), F.lit(1).alias("written")).unionByName(
        new.select("comment_id", "polarity", F.lit(2).alias("written")))
    return sinks.upsert(old, twice, ["comment_id"], "written").drop("written")


@register
def replaced_aspects(t):  # K4: the aspects of the well scored reviews are written anew
    scored = t.reviews.filter(F.col("score") >= 4)
    rows = t.aspects.select("comment_id", "aspect_name", F.lit("old").alias("state"))
    redone = t.aspects.filter(F.col("polarity") == "positive").join(scored.select("comment_id"), "comment_id", "left_semi").select(
        "comment_id", "aspect_name", F.lit("new").alias("state"))
    return sinks.replace_children(rows, redone, scored, "comment_id")


@register
def missing_after_write(t):  # K10 U3
    return sinks.still_missing(t.layered.select("comment_id", "layer"), t.partial_sentiment, ["comment_id"])


# --- text features and models ---------------------------------------------------------------------------

STOP_WORDS = ("the", "of", "and", "le", "la", "der", "die")


@register
def modelling_counters(t):  # T2
    return features.input_counters(t.reviews)


@register
def token_report(t):  # T1 T2 T3 T6
    return features.token_report(t.features, STOP_WORDS)


@register
def top_terms(t):  # T6
    return features.top_terms(t.features)


@register
def tfidf_rows(t):  # T4 T5
    return features.weighted_terms(t.stored_features, t.rules).filter("weight > 0").groupBy("comment_id").agg(
        F.count(F.lit(1)).alias("terms"), F.round(F.sum("weight"), 3).alias("weight"))


@register
def baseline_metrics(t):  # T7 T8 T9 T13
    return baseline.evaluation(t.stored_features, t.rules).drop("metrics_json")


@register
def baseline_confusion(t):  # T10 T11
    return baseline.confusion(t.stored_features, t.rules)


@register
def baseline_predictions(t):  # T12 P18 J3
    predicted = baseline.predictions(t.stored_features, t.rules)
    return baseline.prediction_entities(predicted, t.clean.select("comment_id", "spot_name"))[0].select(
        "comment_id", "spot_name", "method", "polarity")


@register
def mean_sentiment(t):  # sentiment_avg from the annotated rows
    return baseline.mean_sentiment(t.sentiment, ["spot_name"])


def _topic_rows(t: BenchTables) -> DataFrame:
    """What the topic models read of the features."""
    return t.stored_features.select("comment_id", "spot_name", "filtered_tokens")


def _global_model(t: BenchTables, rows: DataFrame):
    """Term numbers, counts, and the fitted document and term weights of the model over everything."""
    terms = topics.numbered_terms(rows, t.rules)
    counts = cut_lineage(topics.global_counts(rows, terms))
    return terms, counts, *topics.fit_per_entity(counts, t.rules)


@register
def global_topics(t):  # T14 T16 K5
    _, counts, docs, _ = _global_model(t, _topic_rows(t))
    return topics.with_topic_ids(topics.global_topics(docs, counts, t.rules))


@register
def global_topic_words(t):  # T15 W3 K5
    terms, counts, docs, weights = _global_model(t, _topic_rows(t))
    ids = topics.with_topic_ids(topics.global_topics(docs, counts, t.rules))
    return topics.with_topic_numbers(topics.global_topic_words(weights, terms, t.rules), ids)


@register
def entity_topics(t):  # T17 T16
    counts = cut_lineage(topics.term_counts(_topic_rows(t), t.spots, t.rules))
    docs, _ = topics.fit_per_entity(counts, t.rules)
    return topics.with_topic_ids(topics.entity_topics(docs, counts, t.rules))


@register
def topics_shown(t):  # T19 T15 J11
    rows = _topic_rows(t)
    counts = cut_lineage(topics.term_counts(rows, t.spots, t.rules))
    docs, terms = topics.fit_per_entity(counts, t.rules)
    numbers, all_counts, all_docs, weights = _global_model(t, rows)
    rates = topics.with_topic_ids(topics.entity_topics(docs, counts, t.rules).unionByName(
        topics.global_topics(all_docs, all_counts, t.rules)))
    words = topics.entity_topic_words(terms, t.rules).unionByName(topics.global_topic_words(weights, numbers, t.rules))
    shown = topics.topics_for(t.spots, rates, words)
    return shown.withColumn("words", F.array_join(F.transform("words", lambda w: w["word"]), ","))


# --- segmentation (T1): the bench texts have no Chinese, so their runs of letters are segmented -----

LETTER_RUNS = segmentation.SegmentRules(run="\\p{L}+", other="\\p{N}+")


@register
def segment_words(t):  # T1, the model
    runs = segmentation.run_counts(t.table("documents"), "text", LETTER_RUNS)
    return segmentation.segment_words(cut_lineage(runs), LETTER_RUNS)


@register
def segmented_tokens(t):  # T1, the tokens of every document
    texts = t.table("documents").select("doc_id", "text")
    return segmentation.segment(texts, "doc_id", "text", LETTER_RUNS).select(
        "doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


def _segmented_features(t: BenchTables) -> DataFrame:
    """T2 to T6 on segmented tokens; the reviews are read several times, so what is used of them is stored."""
    rows = cut_lineage(t.reviews.select("comment_id", "spot_name", "score", "content", "is_low_info", "is_dup_content"))
    texts = segmentation.segment(rows, "comment_id", "content", LETTER_RUNS)
    return features.modelling_input(texts, ("la", "le"), token_column="tokens")


@register
def segmented_token_report(t):  # T2 T3 T6
    return features.token_report(_segmented_features(t), ("la", "le"))


@register
def segmented_top_terms(t):  # T6
    return features.top_terms(_segmented_features(t))


# --- gapless numbers (K5) ---------------------------------------------------------------------------

@register
def numbered_terms(t):  # K5 T4, the vocabulary of the topics
    return topics.numbered_terms(t.features, t.rules)


@register
def numbered_reviews(t):  # K5, parent and child: entities get a number by their reviews, reviews carry it
    counts = t.clean.groupBy("spot_name").agg(F.count(F.lit(1)).alias("n"))
    spots = numbering.numbered(counts, ["n", "spot_name"], "spot_no", descending=["n"])
    rows = numbering.with_parent_number(t.clean.select("comment_id", "spot_name", "publish_date"), spots, ["spot_name"], "spot_no", "comment_id", 1_000)
    return numbering.numbered(rows, ["spot_no", "publish_date", "comment_id"], "review_no").select("comment_id", "spot_no", "review_no")


# --- statistics by increments (K1, K3), stored models (K11), counters of one write (Q10, S12) ----------

def fresh_folder(t: BenchTables, name: str) -> str:
    """A new folder that all executors reach."""
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _kept_statistics(t: BenchTables) -> increments.IncrementalStatistics:
    """All reviews in three batches: earlier dates under other values, then later dates, then the corrections."""
    kept = increments.IncrementalStatistics(t.spark, fresh_folder(t, "increments"))
    rows = cut_lineage(t.clean.select(*increments.READ))
    early = F.coalesce(F.col("publish_date") < "1996-01-01", F.lit(True))
    wrong = {"score": F.lit(1), "ip_province": F.lit("elsewhere"), "publish_date": F.date_add("publish_date", 4000),
             "spot_name": F.concat(F.lit("old "), "spot_name"), "like_count": F.col("like_count") + 7}
    kept.apply(rows.filter(early).withColumns(wrong).withColumn("written", F.lit(0)), 0)
    kept.apply(rows.filter(~early).withColumn("written", F.lit(1)), 1)
    kept.compact()
    kept.apply(rows.filter(early).withColumn("written", F.lit(2)), 2)
    return kept


@register
def incremental_spot_statistics(t):  # K1 K3 A1 A2
    return increments.spot_statistics(_kept_statistics(t).state(), t.rules)


@register
def incremental_time_statistics(t):  # K1 K3 A3 A4
    return increments.time_statistics(_kept_statistics(t).state(), t.rules).drop("sentiment_avg", "stat_version")


@register
def incremental_origin_statistics(t):  # K1 K3 A5 A6
    return increments.origin_statistics(_kept_statistics(t).state(), t.rules).drop("stat_version")


@register
def stored_model_predictions(t):  # K11 T12: trained, stored, loaded, applied
    rows = t.stored_features
    store = ModelStore(t.spark, fresh_folder(t, "models"))
    terms, classes = baseline.train(rows, t.rules)
    store.save("bayes", {"terms": terms, "classes": classes})
    scores = baseline.predict(rows, *store.load("bayes", "terms", "classes"))
    return baseline.predictions(rows, t.rules, scores).select("comment_id", "spot_name", "method", "polarity")


@register
def observed_cleaning_steps(t):  # Q10 S12: counted by the write itself
    stored, run = cleaning.store_counted(t.raw_with_bad_dates, fresh_folder(t, "cleaned"), t.rules)
    gates.require_count(run.counts("normalise fields")["rows"], run.counts("flags")["rows"])
    return cleaning.observed_steps(t.spark, run)


# --- failing texts (M5), exact files (K6, S3-S5), union of pools (U2) ---------------------------------

def breaking_annotator():
    """Raises, for the whole call, if any of its texts has no small letter."""
    def annotate(texts):
        given = texts.fillna("")
        if (given.str.upper() == given).any():
            raise ValueError("no small letter")
        return [{"raw_text": str(n), "prompt_tokens": n} for n in given.str.len().tolist()]

    return annotate


@register
def isolated_annotator_failures(t):  # M5 M12: one text breaks the call of many
    return annotation.run_annotator(t.clean, breaking_annotator(), batch_rows=500).select(
        "comment_id", "error_kind", "prompt_tokens")


def _exact_files(t: BenchTables) -> str:
    """All flagged reviews with their entity's fields as exact CSV in a fresh folder."""
    folder = fresh_folder(t, "exact-csv")
    rows = t.reviews.drop(*entities.DESCRIPTIVE_COLUMNS)
    files.write_exact_csv(entities.with_spot_fields(rows, t.spots), folder)
    return folder


@register
def exact_csv_lines(t):  # K6: the records between line ends, and the header once (readers take the byte-order mark away)
    lines = t.spark.read.option("lineSep", "\r\n").text(_exact_files(t))
    marked = lines.select((F.col("value") == ",".join(CLEANED_CSV_SCHEMA.fieldNames())).alias("is_header"), F.sha2("value", 256).alias("line_sha256"))
    return marked.filter("NOT is_header").unionByName(marked.filter("is_header").distinct())


@register
def csv_round_trip(t):  # K6 S3 S4 S5: written, its headers checked, read with the declared schema
    back = review_sources.read_cleaned_csv(t.spark, _exact_files(t))
    return back.select("comment_id", "spot_name", "score", F.md5("content").alias("content_md5"), "publish_date", "like_count", "address",
                       "phone", "content_length", "ip_province", "is_low_info", "is_dup_content", "dup_group_id")


@register
def header_contract(t):  # S4: files by what their header lacks, with the rows that lie under it
    folder = _exact_files(t)
    wrong = CLEANED_CSV_SCHEMA.fieldNames()[:3][::-1]
    fields = ("score", "comment_id", F.concat(F.lit('a "b", '), "spot_name"))
    rows = t.clean.select(*fields).toDF(*wrong).repartition(F.col(wrong[1]))
    # One deviating file of three short columns.  Its writer puts the header first: the parts of a union may be
    # merged in another order, as where their rows lie decides.
    rows.coalesce(1).write.option("header", True).csv(f"{folder}/late")
    headers = review_sources.file_headers(t.spark, f"{folder}/*")
    found = review_sources.header_deviations(headers, CLEANED_CSV_SCHEMA.fieldNames())
    return found.groupBy("columns", "position", "found", "wanted").agg(F.count(F.lit(1)).alias("files"))


@register
def precedence_union(t):  # U2 J7: three overlapping pools, the first that has a review names it
    pool = lambda name, rows: rows.select("comment_id", "spot_name", F.lit(name).alias("pool"))
    return sinks.precedence_union([
        pool("duplicate", t.reviews.filter("is_dup_content = 1")), pool("short", t.reviews.filter("is_low_info = 1")),
        pool("rated", t.reviews.filter("score IS NOT NULL"))], ["comment_id"])
