"""Numbers, exact samples, statistics by increments, stored models, counters of a write."""

import datetime
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import baseline, cleaning, features, increments, numbering, statistics, topics
from cairn.rules import Rules
from cairn.sinks.models import ModelStore
from cairn.sources import gates, sampling

RULES = Rules(topics=2, topic_iterations=3, min_df=2.0)


@pytest.mark.parametrize("parts", [1, 7])
def test_numbers_are_gapless_and_in_order(spark, parts):
    rng = random.Random(parts)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 9])) for i in range(500)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, v int").repartition(parts)
    got = {r.id: r.no for r in numbering.numbered(df, ["v", "id"], "no", descending=["v"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
    assert numbering.numbered(df.filter("false"), ["v"], "no").count() == 0


def test_children_carry_their_parents_number(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2)], "name string, no bigint")
    children = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 95 else None if i < 97 else "x") for i in range(100)], "id bigint, name string")
    got = numbering.with_parent_number(children, parents, ["name"], "no", "id", rows_per_task=10).collect()
    assert {r.id: r.no for r in got} == {i: 1 if i < 90 else 2 if i < 95 else None for i in range(100)}


@pytest.mark.parametrize("rows,last", [(0, 10), (1, 1), (37, 1), (250, 3), (400, 10), (999, 10)])
def test_exact_sample_is_that_of_the_digests(spark, monkeypatch, rows, last):
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    monkeypatch.setattr(sampling, "_LAST_CLASS", last)
    data = [(i, i * i) for i in range(400)]
    want = sorted(data, key=lambda r: hashlib.md5(f"7:{r[0]}".encode()).hexdigest())[:rows]
    for parts in (1, 5):
        df = spark.createDataFrame(data, "id bigint, v bigint").repartition(parts)
        got = sampling.exact_sample(df, rows, "id", 7)
        assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == df.columns


def test_exact_sample_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1,)] * 30 + [(None,)] * 5 + [(2,)], "id bigint")
    assert [sampling.exact_sample(df, n, "id").count() for n in (0, 3, 33, 36, 50)] == [0, 3, 33, 36, 36]
    assert sampling.exact_sample(df.filter("false"), 3, "id").count() == 0


# --- topics over everything ------------------------------------------------------------------------------

def test_global_topics_equal_plain_em(spark):
    rng = random.Random(3)
    docs = {i: [rng.choice(["lake", "boat", "water"] if i % 2 else ["queue", "ticket", "price", "rare" + str(i)]) for _ in range(12)] for i in range(14)}
    rows = spark.createDataFrame([(i, "a", 5, w) for i, w in docs.items()], "comment_id bigint, spot_name string, score int, filtered_tokens array<string>")
    terms = topics.numbered_terms(rows, RULES)
    numbers = {r.term: r.term_id for r in terms.collect()}
    assert sorted(numbers.values()) == list(range(6)) and not any(t.startswith("rare") for t in numbers)
    counts = topics.global_counts(rows, terms)
    cells = {(r.doc, r.term): r.cnt for r in counts.collect()}
    assert cells == {(i, numbers[t]): float(w.count(t)) for i, w in docs.items() for t in set(w) if t in numbers}
    start = counts.select("doc", "term", *[(F.pmod(F.xxhash64("scope_id", "doc", "term", F.lit(RULES.seed + i)), F.lit(10_000)) / 10_000.0 + 1e-4).alias(f"g{i}")
                                           for i in range(2)]).collect()
    gamma = {(r.doc, r.term): [cells[r.doc, r.term] * g / (r.g0 + r.g1) for g in (r.g0, r.g1)] for r in start}
    alpha, eta = 50.0 / 2 + 1.0, 1.1
    for turn in range(RULES.topic_iterations + 1):
        d, t = {}, {}
        for (doc, term), g in gamma.items():
            for k in range(2):
                d.setdefault(doc, [0.0, 0.0])[k] += g[k]
                t.setdefault(term, [0.0, 0.0])[k] += g[k]
        if turn == RULES.topic_iterations:
            break
        n = [sum(x[k] for x in t.values()) for k in range(2)]
        for (doc, term), cnt in cells.items():
            p = [(t[term][k] + eta - 1) * (d[doc][k] + alpha - 1) / (n[k] + len(t) * (eta - 1)) for k in range(2)]
            gamma[doc, term] = [cnt * x / sum(p) for x in p]
    fitted_docs, weights = topics.fit_per_entity(counts, RULES)
    assert {r.doc: pytest.approx(d[r.doc]) for r in fitted_docs.collect()} == {r.doc: [r.d0, r.d1] for r in fitted_docs.collect()}
    assert {r.term: pytest.approx(t[r.term]) for r in weights.collect()} == {r.term: [r.t0, r.t1] for r in weights.collect()}
    shares = topics.with_topic_ids(topics.global_topics(fitted_docs, counts, RULES))
    assert [(r.topic_id, r.topic_index, r.sample_size) for r in shares.orderBy("topic_id").collect()] == [(1, 0, 14), (2, 1, 14)]
    words = topics.with_topic_numbers(topics.global_topic_words(weights, terms, RULES), shares).collect()
    assert {(r.topic_id, r.word) for r in words} == {(k + 1, w) for k in range(2) for w in numbers}


# --- statistics by increments ------------------------------------------------------------------------------

REVIEW = "comment_id bigint, spot_name string, publish_date date, ip_province string, score int, image_count int, like_count bigint, is_low_info int"


def reviews(seed, ids):
    rng = random.Random(seed)
    return [(i, rng.choice(["甲", "甲", "乙", None]), rng.choice([None, *(datetime.date(2020 + k % 3, 1 + k, 9) for k in range(9))]),
             rng.choice([None, " ", "北京", "法国"]), rng.choice([None, 1, 2, 3, 4, 5]), rng.choice([0, 2, None]), rng.choice([0, 7]), rng.randrange(2)) for i in ids]


def equal(kept, plain, rules=RULES):
    for name in ("spot_statistics", "time_statistics", "origin_statistics"):
        got, want = getattr(increments, name)(kept, rules), getattr(statistics, name)(plain, rules=rules)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())), name


def test_state_after_replacements_equals_all_reviews(spark, tmp_path):
    kept, current = increments.IncrementalStatistics(spark, str(tmp_path / "kept"), buckets=3), {}
    for batch, ids in enumerate([range(120), range(80, 160), [5, 5, 6, 200], []]):
        rows = [(*r, 1000 * batch + k) for k, r in enumerate(reviews(batch, ids))]
        current |= {r[0]: r[:-1] for r in rows}
        incoming = spark.createDataFrame(rows, REVIEW + ", written int").withColumn("more", F.lit(1))
        kept.apply(incoming, batch)
        kept.apply(incoming, batch)  # again: nothing changes
        equal(kept.state(), spark.createDataFrame(list(current.values()), REVIEW))
        if batch == 1:
            kept.compact()
            kept.apply(incoming, 0)  # folded, and still known
            equal(kept.state(), spark.createDataFrame(list(current.values()), REVIEW))


def test_a_run_that_died_before_its_mark_counts_once(spark, tmp_path, monkeypatch):
    kept = increments.IncrementalStatistics(spark, str(tmp_path / "kept"), buckets=2)
    first, second = (spark.createDataFrame([(*r, 0) for r in reviews(k, range(30 * k, 30 * k + 50))], REVIEW + ", written int") for k in range(2))
    kept.apply(first, 0)

    def die(batch, folds):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(kept, "_mark", die)
        with pytest.raises(RuntimeError):
            kept.apply(second, 1)
    equal(kept.state(), first.drop("written"))
    kept.apply(second, 1)
    equal(kept.state(), first.join(second, "comment_id", "left_anti").unionByName(second).drop("written"))


# --- stored models and counters ------------------------------------------------------------------------------

def test_stored_model_predicts_like_the_fresh_one(spark, tmp_path):
    texts = {0: "lake water blue lake boat", 1: "crowd queue ticket price queue"}
    tokens = features.modelling_input(spark.createDataFrame(
        [(i, "甲", 5 if i % 2 == 0 else 1, texts[i % 2] + f" extra{i % 5}", 0, 0) for i in range(40)],
        "comment_id long, spot_name string, score int, content string, is_low_info int, is_dup_content int"))
    store = ModelStore(spark, str(tmp_path / "models"))
    with pytest.raises(ValueError):
        store.load("bayes", "terms")
    terms, classes = baseline.train(tokens, RULES)
    assert store.save("bayes", {"terms": terms, "classes": classes}) == 1
    assert store.save("bayes", {"terms": terms.limit(0), "classes": classes}) == 2
    fresh = sorted(map(tuple, baseline.scored(tokens, RULES).collect()))
    assert sorted(map(tuple, baseline.predict(tokens, *store.load("bayes", "terms", "classes", version=1)).collect())) == fresh
    assert sorted(map(tuple, baseline.predict(tokens, *store.load("bayes", "terms", "classes")).collect())) != fresh
    assert [tuple(r) for r in store.history("bayes").collect()] == [(1, False), (2, True)]
    with pytest.raises(ValueError):
        store.load("bayes", "terms", version=3)


RAW = "comment_id string, spot_name string, score string, score_desc string, content string, publish_date string, ip_location string, " \
      "user_nick string, like_count string, image_count string, image_urls string"


@pytest.mark.parametrize("texts", [["good", "good", "a long text", None, "bad date", "x" * 30, "x" * 30], []])
def test_counters_of_the_write_equal_a_second_scan(spark, tmp_path, texts):
    raw = spark.createDataFrame([(str(i), "甲", "5", None, t, "2020-13-01" if t == "bad date" else "2020-1-2", "北京", "n", "1", "0", None)
                                 for i, t in enumerate(texts)], RAW)
    rules = Rules()
    stored, run = cleaning.store_counted(raw, str(tmp_path / "cleaned"), rules)
    got = cleaning.observed_steps(spark, run)
    want = cleaning.step_counters(raw, rules).drop("detail_json")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert stored.count() == gates.require_count(run.counts("flags")["rows"], len([t for t in texts if t != "bad date"]))
    with pytest.raises(gates.GateError):
        gates.require_count(run.counts("flags")["rows"], 99)
