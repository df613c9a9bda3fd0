"""Rates, denominators, roll-ups, opinions, comparison."""

import datetime

from pyspark.sql import functions as F

from cairn.operators import compare, opinions, quality, statistics
from cairn.rules import Rules

DAY = datetime.date(2023, 5, 1)
SCHEMA = ("spot_name string, score int, publish_date date, ip_province string, like_count long, image_count int, "
          "is_low_info int, comment_id long")


def table(spark, rows):
    return spark.createDataFrame(
        [(s, score, day, region, 1, 0, 0, i) for i, (s, score, day, region) in enumerate(rows)], SCHEMA)


def test_denominators(spark):
    df = table(spark, [("甲", 5, DAY, None), ("甲", None, DAY, " "), ("甲", 1, DAY, "四川"), ("乙", None, DAY, "香港")])
    got = {r.spot_name: r for r in statistics.spot_statistics(df).collect()}
    assert (got["甲"].positive_rate, got["甲"].negative_rate, got["甲"].avg_score) == (0.5, 0.5, 3.0)
    assert (got["乙"].positive_rate, got["乙"].avg_score, got["乙"].image_rate) == (None, None, 0.0)
    assert got["甲"].valid_ip_sample == 1


def test_half_up(spark):
    df = table(spark, [("甲", 5 if i == 0 else 3, DAY, None) for i in range(800)])
    assert statistics.spot_statistics(df).first().positive_rate == 0.0013  # 1/800


def test_origin_shares(spark):
    df = table(spark, [("甲", 5, DAY, "四川")] * 3 + [("甲", 5, DAY, "香港"), ("乙", 5, DAY, "四川"), ("乙", 4, DAY, None)])
    rows = statistics.origin_statistics(df).collect()
    by = {(r.scope_type, r.spot_name, r.ip_province): (r.review_count, r.ratio, r.sample_size, r.is_overseas) for r in rows}
    assert by[("global", None, "四川")] == (4, 0.8, 5, 0)
    assert by[("spot", "甲", "香港")] == (1, 0.25, 4, 1)
    sums = statistics.origin_statistics(df).groupBy("scope_type", "spot_name").agg(F.round(F.sum("ratio"), 3).alias("s"))
    assert {r.s for r in sums.collect()} == {1.0}


def test_time_levels_match_direct_counts(spark):
    days = [datetime.date(2020 + i % 3, i % 12 + 1, 1) for i in range(60)]
    df = table(spark, [("甲" if i % 2 else "乙", i % 6 or None, d, None) for i, d in enumerate(days)])
    rows = statistics.time_statistics(df, spot_months=True)
    for (kind, scope), period in {("year", "global"): F.year("publish_date").cast("string"),
                                  ("month", "spot"): F.date_format("publish_date", "yyyy-MM")}.items():
        keys = [period.alias("period")] + ([F.col("spot_name")] if scope == "spot" else [])
        want = {tuple(r) for r in df.groupBy(*keys).agg(F.count(F.lit(1)), F.round(F.avg("score"), 2)).collect()}
        cols = ["period"] + (["spot_name"] if scope == "spot" else []) + ["review_count", "avg_score"]
        got = {tuple(r) for r in rows.filter((F.col("period_type") == kind) & (F.col("scope_type") == scope)).select(cols).collect()}
        assert got == want
    assert rows.filter("sentiment_avg is not null").count() == 0


def test_aspect_gate_and_alignment(spark):
    rows = [("甲", "风景", "positive")] * 10 + [("甲", "门票", "negative")] * 9 + [("乙", "风景", "negative")] * 10 + [("乙", "交通", "neutral")]
    df = spark.createDataFrame([(i, *r, "annotated") for i, r in enumerate(rows)],
                               "comment_id long, spot_name string, aspect_name string, polarity string, method string")
    got = {(r.spot_name, r.aspect_name): (r.conclusive, r.positive_rate) for r in opinions.aspect_statistics(df).collect()}
    assert got[("甲", "风景")] == (1, 1.0) and got[("甲", "门票")] == (0, None)
    pairs = spark.createDataFrame([("甲", "乙"), ("甲", "甲")], ["spot_a", "spot_b"])
    rows = compare.aspect_alignment(pairs, df).orderBy("rank_no").collect()
    assert [(r.aspect_name, r.sample_size_a, r.sample_size_b) for r in rows] == [("风景", 10, 10), ("门票", 9, None), ("交通", None, 1)]


def test_pair_warning_at_ten(spark):
    snap = spark.createDataFrame([("甲", 1000, 4.5), ("乙", 100, 4.0), ("丙", 101, None)], "spot_name string, review_count long, avg_score double")
    for name in ("positive_rate", "negative_rate", "image_rate", "total_likes"):
        snap = snap.withColumn(name, F.lit(0.5))
    pairs = spark.createDataFrame([("甲", "乙"), ("甲", "丙")], ["spot_a", "spot_b"])
    got = {r.spot_b: r for r in compare.pair_differences(pairs, snap).collect()}
    assert (got["乙"].sample_ratio, got["乙"].reliability_warning, got["乙"].avg_score_delta) == (10.0, 1, 0.5)
    assert (got["丙"].sample_ratio, got["丙"].reliability_warning, got["丙"].avg_score_delta) == (9.9, 0, None)
    assert compare.indicator_rows(pairs, snap).count() == 12


def test_fingerprint_ignores_partitioning_but_not_values(spark):
    df = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    first = quality.fingerprint(df).first()
    assert first == quality.fingerprint(df.repartition(13)).first()
    assert first != quality.fingerprint(df.withColumn("v", F.when(F.col("id") == 9, 99).otherwise(F.col("v")))).first()


def test_verdict(spark):
    checks = spark.createDataFrame([("orphan_spot", 0.0), ("usage_missing", 3.0)], ["check_name", "actual"])
    assert tuple(quality.verdict(checks).first()) == ("READY", [], ["usage_missing"])
    blocked = checks.unionByName(spark.createDataFrame([("illegal_polarity", 1.0)], ["check_name", "actual"]))
    assert quality.verdict(blocked).first().status == "BLOCKED"


def test_descriptive_fields_are_no_dimensions(spark):
    df = table(spark, [("甲", 5, DAY, "四川")])
    leaks = quality.descriptive_dimensions({"spot": statistics.spot_statistics(df), "time": statistics.time_statistics(df, rules=Rules())})
    assert leaks == {"spot": [], "time": []}
