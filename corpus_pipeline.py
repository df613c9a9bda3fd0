"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix, shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontamination, mixing, near_dedup, perplexity, sharding
from cairn.session import ensure_checkpoint_dir

SHARDS = 8


# Every stage takes a stored table, gives the columns of its input as they are (the last one adds two), leaves
# names that its operator uses inside alone, and gives an empty table for an empty one.  Null texts are empty.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the word rules and their language's perplexity band.

    Null, empty and very short texts go; a null language is one of its own; repeated rows are judged alike.
    """
    return perplexity.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, similarity 0.85) the row of the smallest doc_id.

    Repeated rows leave one; a null doc_id stays only if its group has no other; texts without words stay.
    """
    return near_dedup.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of ``benchmark``.

    An item of fewer words is one window; null and empty items and an empty benchmark remove nothing.
    """
    return decontamination.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources by weight takes it, up to three times.

    A null source is one source, the last; documents without words are not taken; equal rows share their
    unit's words evenly.
    """
    return mixing.mix_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` (0 to 7, of nearly equal bytes) and ``virtual_slot``; columns of these names are replaced.

    Equal rows share a slot; one that is large is split by lanes.
    """
    slotted = sharding.with_slots(docs)
    return sharding.assign_shards(docs, sharding.balanced_map(slotted, SHARDS))


STAGES = [
    ("quality rules", quality_rules),
    ("near-dedup", near_dedup_stage),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The stages choose by trained models, hashes and checksums that DuckDB does not have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written and read again, so a lost executor
    costs one stage at most."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{folder}/{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
