"""Routing: types, entity linking against brute force, budgets."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import linking, questions


@pytest.mark.parametrize("text, kind", [
    ("甲湖怎么样", "SPOT_EVALUATION"), ("帮我订甲湖的酒店", "OUT_OF_SCOPE"), ("甲湖和乙山哪个好", "SPOT_COMPARISON"),
    ("评论最多的景点", "RANKING"), ("游客关注什么", "VISITOR_FOCUS"), ("为什么差评多", "SENTIMENT_EXPLAIN"),
    ("有多少条评论", "DATA_METRIC"), ("  ", "OUT_OF_SCOPE"), ("你好", "OUT_OF_SCOPE")])
def test_types(spark, text, kind):
    df = spark.createDataFrame([(1, text)], ["question_id", "question"])
    assert questions.classify(df).first().question_type == kind


@pytest.mark.parametrize("text, n", [("前十名", 10), ("前五", 5), ("Top15", 15), ("前二十", 20), ("排行", 10), ("top30", 3)])
def test_ranking_size(spark, text, n):
    assert spark.range(1).select(questions.ranking_size(F.lit(text))).first()[0] == n


def brute_force(text, names, limit=5):
    """Direct statement of the linking rule over all names."""
    found = []
    for name, reviews in names:
        if len(name) < 2:
            continue
        options = [name] + [name[:n] for n in range(len(name) - 1, 2, -1)]
        token = next((o for o in options if o in text), None)
        if token:
            found.append((token != name, -len(token), -reviews, text.find(token), name, token))
    kept, spans = [], []
    for _, _, _, start, name, token in sorted(found):
        end = start + len(token)
        if len(kept) >= limit or any(s < end and start < e for s, e in spans):
            continue
        spans.append((start, end))
        if name not in kept:
            kept.append(name)
    return sorted(kept, key=lambda n: text.find(n) if n in text else text.find(n[:3]))


def test_linking_equals_brute_force(spark):
    rng = random.Random(7)
    letters = "abc湖山"
    names = sorted({"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(60)})
    names = [(n, i * 3 + 1) for i, n in enumerate(names)]
    asked = [(i, "".join(rng.choices(letters, k=rng.randint(0, 14)))) for i in range(120)]
    spots = spark.createDataFrame(names, ["spot_name", "review_count"])
    linked = linking.link_entities(spark.createDataFrame(asked, ["question_id", "question"]), spots)
    got = {}
    for row in linked.orderBy("question_id", "mention_no").collect():
        got.setdefault(row.question_id, []).append(row.spot_name)
    for question_id, text in asked:
        want = brute_force(text, names)
        assert sorted(got.get(question_id, [])) == sorted(want), text
        firsts = [text.find(n) if n in text else text.find(n[:3]) for n in got.get(question_id, [])]
        assert firsts == sorted(firsts)


def test_shared_prefix_prefers_more_reviews(spark):
    spots = spark.createDataFrame([("纳木措景区东", 3), ("纳木措景区西", 900), ("羊湖", 5)], ["spot_name", "review_count"])
    asked = spark.createDataFrame([(1, "羊湖和纳木措景区比起来")], ["question_id", "question"])
    rows = linking.link_entities(asked, spots).orderBy("mention_no").collect()
    assert [r.spot_name for r in rows] == ["羊湖", "纳木措景区西"]


def test_budget_is_a_prefix(spark):
    facts = spark.createDataFrame([(1, 0, i, "s", "t", "x" * 100) for i in range(40)] + [(2, 0, i, "s", "t", "y") for i in range(40)],
                                  ["question_id", "block_no", "item_no", "source", "title", "item"])
    kept = {r.question_id: (r.n, r.m) for r in questions.context_budget(facts).groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("item_no").alias("m")).collect()}
    assert kept == {1: (30, 29), 2: (30, 29)}
    assert questions.context_budget(facts, max_chars=450).filter("question_id = 1").count() == 4


def test_record_policy(spark):
    rows = spark.createDataFrame([("RANKING", None), ("RANKING", "LLM_FAILED"), ("OUT_OF_SCOPE", None)], "question_type string, reason string")
    assert questions.recorded(rows).count() == 1
