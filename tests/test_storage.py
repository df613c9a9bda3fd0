"""What stored steps leave on disk, and what their rows need not be shuffled for again."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from cairn.operators import features, quality, topics
from cairn.rules import Rules
from cairn.session import cut_lineage, ensure_checkpoint_dir, forget

ROWS = 20


def shuffles(spark) -> set[str]:
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def checkpoints(spark) -> set[str]:
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    return {d for d in os.listdir(top) if d.startswith("rdd-")}


def test_a_stored_step_leaves_no_shuffle_files(spark):
    before = shuffles(spark)
    stored = cut_lineage(spark.range(ROWS).repartition(4, "id").groupBy((F.col("id") % 3).alias("k")).count())
    assert len(stored.collect()) == 3
    until = time.time() + 20  # executors remove them on their own time
    while not shuffles(spark) <= before and time.time() < until:
        time.sleep(0.2)
    assert shuffles(spark) <= before


def test_a_forgotten_step_leaves_no_files(spark):
    ensure_checkpoint_dir(spark)
    before = checkpoints(spark)
    forget(cut_lineage(spark.range(ROWS)))
    assert checkpoints(spark) <= before


def test_topics_keep_no_iteration_but_the_last(spark):
    rows = [("a", f"d{d}", f"t{(d * t) % 7}", float(t)) for d in range(8) for t in range(1, 4)]
    counts = cut_lineage(spark.createDataFrame(rows, "scope_id string, doc string, term string, cnt double").dropDuplicates(["doc", "term"]))
    before = checkpoints(spark)
    docs, terms = topics.fit_per_entity(counts, Rules(topics=2, topic_iterations=8))
    # The two results, the numbers of terms and scopes, and none of the iterations.
    assert len(checkpoints(spark) - before) < 8
    assert docs.count() == 8 and terms.count() == 7 and counts.count() > 0


@pytest.mark.parametrize("kept", [False, True])
def test_terms_of_rows_dealt_by_their_key_are_counted_where_they_lie(spark, kept):
    rows = spark.createDataFrame([(i % 7, ["a", "b", "a", f"w{i}"]) for i in range(ROWS)], "comment_id bigint, filtered_tokens array<string>")
    stored = cut_lineage(rows.repartition(3, "comment_id"), keep_partitioning=kept)
    terms = features.term_rows(stored)
    assert ("Exchange" not in terms._jdf.queryExecution().executedPlan().toString()) == kept
    assert {(r.comment_id, r.term): r.n for r in terms.collect()}[0, "a"] == 6


def test_layer_checks_move_no_text_through_their_joins(spark):
    layered = spark.createDataFrame([(1, "call", 0, "text"), (2, "excluded", 0, " "), (3, "rule", 1, "x")],
                                    "comment_id bigint, layer string, is_low_info int, content string")
    sentiment = spark.createDataFrame([(1, Rules().annotated_method)], "comment_id bigint, method string")
    semantic = spark.createDataFrame([(1, "call"), (2, "rule")], "comment_id bigint, source string")
    checks = quality.layer_checks(layered, sentiment, semantic)

    def joined(node) -> list[str]:
        children = [node.children().apply(i) for i in range(node.children().size())]
        own = [a for c in children for a in str(c.output().toString()).split(", ")] if node.nodeName() == "Join" else []
        return own + [a for c in children for a in joined(c)]

    inputs = joined(checks._jdf.queryExecution().optimizedPlan())
    assert inputs and not any("content" in a for a in inputs)
    assert {r.check_name: r.actual for r in checks.collect()} == {
        "layers_not_exhaustive": 0, "layer_pending_mismatch": 0, "rule_result_on_normal_text": 1, "result_on_empty_text": 1, "nothing_pending": 0}
