"""The dealt operators as registered queries over the whole tables, with production parameters.

Each query applies its operator and derives the columns that its contract names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bloom_lm, decontamination, jaccard_join, licenses, mixing, near_dedup, periodic_runs, perplexity, pii, prefix_trie, rule_ensemble, sharding, suffix_dedup

_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_register
def op1_benchmark_decontamination(spark, sf_dir):
    found = decontamination.contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@_register
def op2_virtual_slot_sharding(spark, sf_dir):
    return sharding.placed_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=8)


@_register
def op5_source_mixing(spark, sf_dir):
    takes = mixing.document_takes(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return takes.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


@_register
def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register
def op4_rule_ensemble_quality(spark, sf_dir):
    return rule_ensemble.score_quality(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@_register
def op9_perplexity_quality_rules(spark, sf_dir):
    judged = perplexity.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "log_perplexity")


@_register
def op3_bloom_lm_scoring(spark, sf_dir):
    return bloom_lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register
def op10_skip_chain_pii(spark, sf_dir):
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [pii.count_of("base", k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@_register
def op8_suffix_array_dedup(spark, sf_dir):
    done = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"),
                       F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op7_license_scan(spark, sf_dir):
    """Documents as files ``source/lang/doc_id``."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.col("doc_id").cast("string"))
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return licenses.with_licenses(files, "path", ["doc_id"])


@_register
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs.collapse_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"],
                                        rewrite=periodic_runs.repeated_tails, reads="doc_id")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "longest.start", "longest.length", "longest.period",
                        F.expr("(1000 * longest.length) div longest.period").alias("exponent_milli"), "runs_sha256",
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@_register
def op11_conversation_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations")))


@_register
def op12_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
