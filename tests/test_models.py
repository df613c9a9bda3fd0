"""Invariants of features, the baseline and the topic models; the driver contract."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.operators import baseline, features, topics
from cairn.rules import Rules

SF = "/root/testdata/sf0.001"
RULES = Rules(topics=2, topic_iterations=3, full_evaluation_min=10, min_df=1.0)


def test_tokens(spark):
    got = spark.createDataFrame([("Hello, 布达宫很美 a1！ 门票",)], ["t"]).select(features.tokens(F.col("t"))).first()[0]
    assert got == ["hello", "布达", "达宫", "宫很", "很美", "a1", "门票"]


@pytest.fixture(scope="module")
def rows(spark):
    texts = {0: "lake water blue lake boat", 1: "crowd queue ticket price queue"}
    return spark.createDataFrame(
        [(i, "甲" if i < 30 else "乙", 5 if i % 2 == 0 else 1, texts[i % 2] + f" extra{i % 5}", 0, 0) for i in range(40)],
        "comment_id long, spot_name string, score int, content string, is_low_info int, is_dup_content int")


def test_baseline_separates_two_vocabularies(spark, rows):
    tokens = features.modelling_input(rows)
    metrics = baseline.evaluation(tokens, RULES).first()
    assert metrics.accuracy == 1.0 and metrics.train_rows == baseline.labelled(tokens, RULES).filter("training").count()
    assert baseline.predictions(tokens, RULES).groupBy("polarity").count().count() == 2


def test_baseline_equals_the_library_classifier(spark, rows):
    """The aggregated model against Spark's own vectoriser and classifier on the same split."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import IDF
    mixed = rows.withColumn("content", F.when(F.col("comment_id") % 3 == 0, F.concat("content", F.lit(" queue boat price"))).otherwise(F.col("content")))
    tokens = features.modelling_input(mixed)
    counted = features.fit_text_model(tokens, RULES).transform(tokens)
    vectors = IDF(inputCol="count_features", outputCol="features").fit(counted).transform(counted)
    classes = baseline.labelled(tokens, RULES).withColumn("no", (F.col("label") / 2))
    model = NaiveBayes(smoothing=1.0, featuresCol="features", labelCol="no").fit(vectors.join(classes.filter("training"), "comment_id"))
    want = {r.comment_id: r.prediction * 2 for r in model.transform(vectors).collect()}
    assert {r.comment_id: r.prediction for r in baseline.scored(tokens, RULES).collect()} == want


def test_entity_topics_cover_every_document(spark, rows):
    tokens = features.modelling_input(rows)
    spots = spark.createDataFrame([("甲", 1), ("乙", 1), ("丙", 1)], ["spot_name", "has_full_evaluation"])
    counts = topics.term_counts(tokens, spots, RULES)
    docs, terms = topics.fit_per_entity(counts, RULES)
    total = counts.agg(F.sum("cnt")).first()[0]
    assert docs.agg(F.sum(F.col("d0") + F.col("d1"))).first()[0] == pytest.approx(total)
    assert terms.agg(F.sum(F.col("t0") + F.col("t1"))).first()[0] == pytest.approx(total)
    shares = topics.entity_topics(docs, counts, RULES).groupBy("scope_id").agg(
        F.round(F.sum("topic_rate"), 3).alias("s"), F.max("sample_size").alias("n")).collect()
    assert {(r.scope_id, r.s, r.n) for r in shares} == {("甲", 1.0, 30), ("乙", 1.0, 10)}
    words = topics.entity_topic_words(terms, RULES)
    assert words.groupBy("scope_id", "topic_index").count().filter("count > 10").count() == 0


def test_blocks_move_no_counts(spark):
    """Scopes cut into blocks of a few counts give the weights of plain EM, with text and number keys."""
    rules = Rules(topics=2, topic_iterations=3)
    rows = [(("甲", "乙")[d % 5 == 0], d, f"w{(d * d + 3 * j) % 17}", float(1 + (d + j) % 3)) for d in range(40) for j in range(5)]
    counts = spark.createDataFrame(rows, "scope_id string, doc long, term string, cnt double")
    k, alpha, eta = 2, 26.0, 1.1
    noise = [F.pmod(F.xxhash64("scope_id", "doc", "term", F.lit(rules.seed + i)), F.lit(10_000)) / 10_000.0 + 1e-4 for i in range(k)]
    start = counts.select("scope_id", "doc", "term", "cnt", *[n.alias(f"n{i}") for i, n in enumerate(noise)]).collect()
    edges = [(r.scope_id, r.doc, r.term, r.cnt) for r in start]
    split = [[r.cnt * r[f"n{i}"] / (r.n0 + r.n1) for i in range(k)] for r in start]
    words = {s: len({t for z, _, t, _ in edges if z == s}) for s in "甲乙"}
    for turn in range(4):
        d, t, n = {}, {}, {}
        for (s, doc, term, _), g in zip(edges, split):
            for held, key in ((d, doc), (t, (s, term)), (n, s)):
                held[key] = [a + b for a, b in zip(held.get(key, [0.0, 0.0]), g)]
        for at, (s, doc, term, cnt) in enumerate(edges):
            p = [(t[s, term][i] + eta - 1) * (d[doc][i] + alpha - 1) / (n[s][i] + words[s] * (eta - 1)) for i in range(k)]
            split[at] = [cnt * x / sum(p) for x in p]
    docs, terms = topics.fit_per_entity(counts, rules, counts_per_block=20)
    assert {r.doc: pytest.approx([r.d0, r.d1]) for r in docs.collect()} == d
    assert {(r.scope_id, r.term): pytest.approx([r.t0, r.t1]) for r in terms.collect()} == t
    empty = topics.fit_per_entity(counts.limit(0), rules)
    assert [x.count() for x in empty] == [0, 0]


def test_topic_fallback(spark):
    spots = spark.createDataFrame([("甲",), ("乙",)], ["spot_name"])
    rates = spark.createDataFrame([("spot", "甲", 0, 1.0, 9, 1), ("global", "", 0, 0.4, 99, 2), ("global", "", 1, 0.6, 99, 3)],
                                  "scope_type string, scope_id string, topic_index int, topic_rate double, sample_size long, topic_id long")
    words = spark.createDataFrame([("global", "", 0, 1, "水", 0.5)],
                                  "scope_type string, scope_id string, topic_index int, rank_no int, word string, weight double")
    got = {(r.spot_name, r.scope_type, r.topic_index) for r in topics.topics_for(spots, rates, words).collect()}
    assert got == {("甲", "spot", 0), ("乙", "global", 0), ("乙", "global", 1)}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="bench tables not present")
@pytest.mark.parametrize("name", ["line_spot_statistics", "clean_reviews", "origin_statistics", "work_layers"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    df = entry.queries()[name](spark, SF)
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(repr([r[columns.index(c)] for c in df.columns]) for r in cursor.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert sorted(repr(list(r)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="bench tables not present")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
