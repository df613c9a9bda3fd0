"""Word segmentation against a plain Python model and Viterbi path."""

import math
import random
import re
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from cairn.operators import features, segmentation

RULES = segmentation.SegmentRules(run="[一-鿿]+", other="[a-z0-9]+", min_count=3, min_cohesion=0.5, min_entropy=0.6, rows_per_task=5)
WORDS = ["布达拉宫", "门票", "风景", "很", "美", "排队", "的", "人", "多", "景区"]


def texts():
    rng = random.Random(6)
    out = []
    for i in range(120):
        parts = ["".join(rng.choice(WORDS) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 4))]
        out.append((i, rng.choice(["，", " ok ", "!", " A1 "]).join(parts)))
    return out + [(200, None), (201, ""), (202, " ,, "), (203, "门票" * 300), (204, "罕"), *[(300 + i, "风景很美") for i in range(40)]]


def places(run):
    for size in range(1, min(4, len(run)) + 1):
        for p in range(len(run) - size + 1):
            yield run[p:p + size], run[p - 1:p] if p else "", run[p + size:p + size + 1]


def model(runs):
    grams, left, right = Counter(), defaultdict(Counter), defaultdict(Counter)
    for run, n in runs.items():
        for g, a, b in places(run):
            grams[g] += n
            left[g][a] += n
            right[g][b] += n
    chars = sum(n for g, n in grams.items() if len(g) == 1)

    def entropy(c):
        total = sum(c.values())
        return math.log(total) - sum(n * math.log(n) for n in c.values()) / total

    kept = {g: n for g, n in grams.items() if len(g) == 1 or n >= 3
            and min(math.log(n * chars / (grams[g[:k]] * grams[g[k:]])) for k in range(1, len(g))) >= 0.5
            and entropy(left[g]) >= 0.6 and entropy(right[g]) >= 0.6}
    total = sum(kept.values())
    return {g: (n, round(math.log(total / n) * 1_000_000)) for g, n in kept.items()}


def viterbi(run, words):
    unknown = max(c for _, c in words.values()) + 1_000_000
    best = [(0, 0)]
    for end in range(1, len(run) + 1):
        ways = []
        for size in range(1, min(4, end) + 1):
            cost = words[run[end - size:end]][1] if run[end - size:end] in words else unknown if size == 1 else None
            if cost is not None:
                ways.append((best[end - size][0] + cost, -size))
        best.append(min(ways))
    out, at = [], len(run)
    while at:
        out.insert(0, run[at + best[at][1]:at])
        at += best[at][1]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(texts(), "id bigint, text string").repartition(3)


def test_model_and_tokens_equal_plain_python(spark, table):
    items = {i: re.findall("[一-鿿]+|[a-z0-9]+", (t or "").lower()) for i, t in texts()}
    runs = Counter(r for found in items.values() for r in found if not re.match("[a-z0-9]", r))
    words = model(runs)
    counts = segmentation.run_counts(table, "text", RULES)
    got = segmentation.segment_words(counts, RULES)
    assert {r.word: (r.n, r.cost) for r in got.collect()} == words
    assert {"门票", "风景", "排队", "景区"} <= set(words) and "票风" not in words
    want = {i: [w for r in found for w in ([r] if re.match("[a-z0-9]", r) else viterbi(r, words))] for i, found in items.items()}
    tokens = segmentation.segment(table, "id", "text", RULES)
    assert {r.id: r.tokens for r in tokens.collect()} == want and want[203][:2] == ["门票", "门票"] and want[202] == []


def test_unknown_characters_and_empty_tables(spark, table):
    words = segmentation.segment_words(segmentation.run_counts(table, "text", RULES), RULES)
    new = spark.createDataFrame([("乾坤门票",)], "run string")
    assert segmentation.segmented_runs(new, words, RULES).first().words == ["乾", "坤", "门票"]
    none = table.filter("false")
    assert segmentation.segment(none, "id", "text", RULES).count() == 0
    assert segmentation.segment_words(segmentation.run_counts(none, "text", RULES), RULES).count() == 0


def test_modelling_input_takes_segmented_tokens(spark, table):
    rows = segmentation.segment(table.withColumnRenamed("text", "content"), "id", "content", RULES).select(
        F.col("id").alias("comment_id"), F.lit("甲").alias("spot_name"), F.lit(5).alias("score"), "content", "tokens",
        F.lit(0).alias("is_low_info"), F.lit(0).alias("is_dup_content"))
    got = features.modelling_input(rows, ["门票"], token_column="tokens")
    assert got.filter("comment_id = 300").first().filtered_tokens == ["风景"]
    assert got.filter(F.array_contains("filtered_tokens", "门票")).isEmpty() and got.filter(F.exists("tokens", lambda w: F.length(w) < 2)).isEmpty()


def shuffled_rows(plan):
    """Rows that the exchanges of a finished plan have written."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_words_of_a_text_are_not_shuffled(spark):
    """A block asks once for each distinct run; its texts move as they are."""
    texts = spark.createDataFrame([(i, "风景很美，门票 a1 排队的人多！" * 20) for i in range(1000)], "id bigint, text string").repartition(3)
    rules = replace(RULES, rows_per_task=100)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = segmentation.segment(texts, "id", "text", rules)
        rows = got.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(rows) == 1000 and len({tuple(r.tokens) for r in rows}) == 1
    assert rows[0].tokens.count("a1") == 20 and "".join(rows[0].tokens) == "风景很美门票a1排队的人多" * 20
    assert shuffled_rows(got._jdf.queryExecution().executedPlan()) < 10_000  # 80,000 items


def test_blocks_without_answers_and_other_columns(spark):
    """Blocks with no run, with no known run, and columns of other types beside the text."""
    texts = spark.createDataFrame([(i, t, {"k": i}, None) for i, t in enumerate(["1 2", "", None, "门票", "乾坤1", "乾"] * 4)],
                                  "id bigint, text string, m map<string,int>, `odd name` timestamp")
    segments = spark.createDataFrame([("门票", ["门", "票"])], "run string, words array<string>")
    got = segmentation.with_tokens(texts, "id", "text", segments, replace(RULES, rows_per_task=1))
    assert got.columns == ["id", "text", "m", "odd name", "tokens"]
    want = [["1", "2"], [], [], ["门", "票"], ["乾坤", "1"], ["乾"]] * 4
    assert {r.id: (r.tokens, r.m) for r in got.collect()} == {i: (w, {"k": i}) for i, w in enumerate(want)}
