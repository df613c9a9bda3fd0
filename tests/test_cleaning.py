"""Golden rows for cleaning, entities and duplicates."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairn.functions.text import norm_phone, norm_text, phone_parts, strip, to_nullable
from cairn.operators import cleaning, duplicates, entities
from cairn.rules import Rules
from cairn.schema import SOURCE_HEADER
from cairn.sources import sidefiles

NAMES = [n for _, n in SOURCE_HEADER]


def raw(spark, rows):
    full = [{n: r.get(n, "") for n in NAMES} for r in rows]
    return spark.createDataFrame([tuple(r[n] for n in NAMES) for r in full], NAMES)


def one(spark, expression, value):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x"))).first()[0]


@pytest.mark.parametrize("value, expected", [
    ("　 a\r\nb\t\tc　　d ", "a b c d"), (None, ""), ("  ", "")])
def test_norm_text(spark, value, expected):
    assert one(spark, norm_text, value) == expected


def test_strip_covers_unicode(spark):
    assert one(spark, strip, "  x y　\x1f") == "x y"
    assert one(spark, to_nullable, " 　") is None


def test_phone(spark):
    value = "全部\n0891-1 ; 2\t 收起 \r\n0891-3"
    assert one(spark, phone_parts, value) == ["0891-1 ; 2", "0891-3"]
    assert one(spark, norm_phone, value) == "0891-1 ; 2; 0891-3"
    assert one(spark, norm_phone, "全部\n展开") is None


def test_review_record(spark):
    rows = raw(spark, [
        {"spot_name": "　甲 ", "comment_id": "1", "score": "5", "content": " 一二三四五六七八九十 ",
         "publish_date": "2022-08-01", "ip_location": "四川 ", "like_count": "", "image_count": "3"},
        {"spot_name": "甲", "comment_id": "2", "content": "一二三四五六七八九十一", "publish_date": "2022-07-31",
         "ip_location": "四川", "like_count": "7"},
        {"spot_name": "甲", "comment_id": "3", "publish_date": "2023-1-5", "ip_location": "未知"},
        {"spot_name": "甲", "comment_id": "4", "publish_date": "2023-13-05"},
        {"spot_name": "甲", "comment_id": "5", "publish_date": "2023/01/05"},
    ])
    got = {r.comment_id: r for r in cleaning.clean_reviews(rows).collect()}
    assert sorted(got) == [1, 2, 3]
    assert (got[1].spot_name, got[1].score, got[1].content_length, got[1].is_low_info) == ("甲", 5, 10, 1)
    assert (got[1].ip_province, got[1].like_count, got[1].image_count) == ("四川", 0, 3)
    assert (got[2].is_low_info, got[2].ip_province, got[2].like_count, got[2].score) == (0, None, 7, None)
    assert (got[3].content, got[3].is_low_info, got[3].ip_is_unknown, got[3].ip_location) == (None, 0, 1, "未知")
    assert got[3].publish_date == datetime.date(2023, 1, 5)
    assert cleaning.split_by_date(rows)[1].count() == 2


def test_overseas_includes_hong_kong(spark):
    df = spark.createDataFrame([("香港",), ("四川",), ("未知",)], ["x"])
    columns = cleaning.region_columns(F.col("x"), Rules())
    assert [r[0] for r in df.select(columns["is_overseas"]).collect()] == [1, 0, 0]


def test_representative_value_ties(spark):
    rows = raw(spark, [
        {"spot_name": "甲", "comment_id": "1", "address": "bb", "open_time": "x1"},
        {"spot_name": "甲", "comment_id": "2", "address": "a", "open_time": "x2"},
        {"spot_name": "甲", "comment_id": "3", "address": "a"},
        {"spot_name": "甲", "comment_id": "4", "address": "bb", "phone": "1" * 60 + "\n" + "2" * 10},
    ])
    scopes = spark.createDataFrame([("甲", "进藏沿线")], ["name", "label"])
    spot = entities.build_spots(rows, sidefiles.scope_labels(scopes)).first()
    assert spot.address == "bb"      # tie in frequency: longer
    assert spot.open_time == "x1"    # tie in length: first seen
    assert spot.phone == "1" * 60    # merged phone too long: first fragment
    assert (spot.source_scope, spot.review_count, spot.has_full_evaluation) == ("route", 4, 0)
    cut = entities.phone_truncations(rows).first()
    assert (cut.merged_length, cut.kept_length) == (72, 60)


def reviews(spark, rows):
    return spark.createDataFrame(
        rows, "comment_id long, spot_name string, content string, content_length int, is_low_info int")


def test_duplicates_and_representatives(spark):
    df = reviews(spark, [(1, "甲", "同样的话", 4, 0), (2, "乙", "同样的话", 4, 0), (3, "甲", "别的", 2, 0),
                         (4, "甲", None, 0, 0), (5, "甲", None, 0, 0)])
    flagged = duplicates.flag_exact_duplicates(df)
    got = {r.comment_id: (r.is_dup_content, r.dup_group_id) for r in flagged.collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, None), 4: (0, None), 5: (0, None)}
    listed = spark.createDataFrame([(9, "1、 3、、2")], ["group_id", "ids"])
    members = sidefiles.duplicate_members(listed)
    assert sorted(r.comment_id for r in members.collect()) == [1, 2, 3]
    marked = duplicates.flag_listed_duplicates(
        reviews(spark, [(1, "甲", "x" * 9, 9, 1), (2, "甲", "y" * 20, 20, 0), (3, "甲", "z" * 20, 20, 0)]), members)
    rep = duplicates.representatives(marked).first()
    assert rep.members == 3
    assert (rep.dup_group_id, rep.representative_id) == (9, 2)  # not low-info, longest, smallest id


def test_hot_group_keeps_every_row(spark):
    df = spark.range(2000).select(
        F.col("id").alias("comment_id"), F.lit("甲").alias("spot_name"),
        F.when(F.col("id") % 3 == 0, "热门文本").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("content"),
        F.lit(4).alias("content_length"), F.lit(0).alias("is_low_info"))
    rules = Rules(hot_key_rows=50)
    flagged = duplicates.flag_exact_duplicates(df, rules)
    members = duplicates.with_representative(flagged, rules)
    assert members.filter("representative_id = 0").count() == 667 and members.count() == 2000
    row = flagged.agg(F.count(F.lit(1)).alias("n"), F.sum("is_dup_content").alias("d"), F.max("dup_group_id").alias("g")).first()
    assert (row.n, row.d, row.g) == (2000, 667, 0)


def test_stop_words_file(spark):
    lines = spark.createDataFrame([("\ufeff# 注释",), ("的 了　的",), ("  ",)], ["value"])
    assert sorted(r.word for r in sidefiles.stop_words(lines).collect()) == ["了", "的"]
