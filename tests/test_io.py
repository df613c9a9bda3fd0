"""Sources, gates, sinks: files in a scratch folder; JDBC is checked through its options only."""

import pytest
from pyspark.sql import functions as F

from cairn.plans import views
from cairn.schema import CLEANED_CSV_SCHEMA, RAW_SCHEMA, SENTIMENT_SCHEMA
from cairn.sinks import files, tables
from cairn.sources import gates, queries, reviews, sampling


def write_csv(path, rows):
    header = ",".join(RAW_SCHEMA.fieldNames())
    path.write_text("\ufeff" + header + "\n" + "\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_csv_with_line_breaks_and_quotes(spark, tmp_path):
    row = '甲,1,5,超棒,"第一行\n他说""好"", 真的",2023-01-02,四川,u,3,,,地址,,,\n'
    df = reviews.read_raw_csv(spark, write_csv(tmp_path / "a.csv", [row.rstrip("\n")]))
    got = df.first()
    assert got.content == '第一行\n他说"好", 真的' and got.spot_name.lstrip("﻿") == "甲" and got.image_count == ""


def test_header_contract(spark, tmp_path):
    bad = tmp_path / "b.csv"
    bad.write_text("景点名称,评论编号\n甲,1\n", encoding="utf-8")
    with pytest.raises(ValueError, match="15 columns"):
        reviews.read_raw_csv(spark, str(bad))
    empty = tmp_path / "c.csv"
    empty.write_text("", encoding="utf-8")
    with pytest.raises(ValueError, match="empty"):
        reviews.read_raw_csv(spark, str(empty))


def test_cleaned_csv_round_trip(spark, tmp_path):
    values = {"comment_id": 5, "score": None, "content": '多行\n"引号"', "publish_date": "2023-01-02", "spot_name": "甲",
              "like_count": 0, "image_count": 2, "content_length": 7, "is_low_info": 1, "is_dup_content": 0}
    names = [n for _, n in reviews.SOURCE_HEADER] + [f for f, _ in files.DERIVED_COLUMNS]
    df = spark.range(1).select(*[F.lit(values.get(n)).alias(n) for n in names])
    path = str(tmp_path / "clean")
    files.write_cleaned_csv(df, path)
    with pytest.raises(Exception, match="exists"):
        files.write_cleaned_csv(df, path)
    files.write_cleaned_csv(df, path, force=True)
    back = reviews.load_reviews(spark, "csv", path=path).first()
    assert (back.comment_id, back.score, back.content, str(back.publish_date), back.ip_is_unknown) == (5, None, '多行\n"引号"', "2023-01-02", 0)
    assert len(CLEANED_CSV_SCHEMA) == 23


def test_jdbc_options():
    options = reviews.jdbc_options("jdbc:x", "(SELECT comment_id, spot_id FROM review) t", partition_column="spot_id")
    assert options["numPartitions"] == "4" and options["upperBound"] == "1000" and options["fetchsize"] == "1000"
    assert "partitionColumn" not in reviews.jdbc_options("jdbc:x", "spot")


def test_source_names(spark):
    with pytest.raises(ValueError):
        reviews.load_reviews(spark, "excel")


def test_gates(spark):
    df = spark.createDataFrame([("甲",), ("乙",)], ["spot_name"])
    spots = spark.createDataFrame([("甲", "tibet", 1)], ["spot_name", "source_scope", "has_full_evaluation"])
    assert gates.require_rows(df, 2) == 2 and gates.require_rows(df, 5, sample=True) == 2
    with pytest.raises(gates.GateError):
        gates.require_rows(df, 3)
    with pytest.raises(gates.GateError, match="乙"):
        gates.require_known_entities(df, spots)
    with pytest.raises(gates.GateError):
        gates.require_entity_counts(spots, {"spots": 2})
    for bad in (lambda: views.trend(df, "week"), lambda: views.ranking(df, df, "likes"), lambda: views.spot_list(df, df, page_size=101)):
        with pytest.raises(ValueError):
            bad()


def test_hash_sample_ignores_partitioning(spark):
    df = spark.range(1000)
    a, b = (sorted(r.id for r in sampling.hash_sample(df.repartition(n), 0.1, "id").collect()) for n in (2, 7))
    assert a == b and 60 < len(a) < 140


def test_bound_parameter_is_not_sql(spark):
    df = spark.createDataFrame([("a' OR '1'='1",), ("b",)], ["x"])
    assert queries.query(spark, "SELECT * FROM {t} WHERE x = :v", {"v": "a' OR '1'='1"}, t=df).count() == 1


def test_keyed_merge_is_idempotent_and_the_last_row_wins(spark, tmp_path):
    table = tables.KeyedTable(spark, str(tmp_path / "t"), ["k"], "at", buckets=4)
    table.create(spark.createDataFrame([(1, "a", 0), (2, "b", 0), (2, "older", -1)], ["k", "v", "at"]))
    new = spark.createDataFrame([(2, "x", 1), (2, "B", 2), (3, "c", 1)], ["k", "v", "at"])
    for _ in range(2):
        table.merge(new)
        assert sorted(map(tuple, table.read().collect())) == [(1, "a", 0), (2, "B", 2), (3, "c", 1)]


def test_upsert_leaves_one_row_for_each_key(spark):
    rows = lambda *r: spark.createDataFrame(list(r), ["k", "v", "at"])
    got = tables.upsert(rows((1, "old", 0), (4, "kept", 0)), rows((1, "x", 1), (1, "y", 2)), ["k"], "at")
    assert sorted(map(tuple, got.collect())) == [(1, "y", 2), (4, "kept", 0)]


def test_every_file_of_a_folder_has_its_header_checked(spark, tmp_path):
    row = '甲,1,5,超棒,好,2023-01-02,四川,u,3,,,地址,,,'
    write_csv(tmp_path / "a.csv", [row])
    shifted = RAW_SCHEMA.fieldNames()
    shifted[0], shifted[1] = shifted[1], shifted[0]
    (tmp_path / "b.csv").write_text(",".join(shifted) + "\n" + row + "\n", encoding="utf-8")
    with pytest.raises(ValueError, match="column 0"):
        reviews.read_raw_csv(spark, str(tmp_path))


def test_saved_model_is_loaded(spark, tmp_path):
    from pyspark.ml.feature import IDF, IDFModel
    from pyspark.ml.linalg import Vectors
    model = IDF(inputCol="x", outputCol="y").fit(spark.createDataFrame([(Vectors.dense([1.0, 0.0]),)], ["x"]))
    files.save_model(model, str(tmp_path / "m"))
    assert files.load_model(IDFModel, str(tmp_path / "m")).docFreq == model.docFreq


def test_scope_replace(spark, tmp_path):
    path = str(tmp_path / "topics")
    rows = [("global", "", 0, 0.5), ("spot", "甲", 0, 0.1), ("spot", "乙", 0, 0.2)]
    names = ["scope_type", "scope_id", "topic_index", "rate"]
    tables.replace_scopes(spark.createDataFrame(rows, names), path)
    tables.replace_scopes(spark.createDataFrame([("spot", "甲", 1, 0.9)], names), path)
    got = {(r.scope_id, r.topic_index) for r in spark.read.parquet(path).filter("scope_type = 'spot'").collect()}
    assert got == {("甲", 1), ("乙", 0)}


def test_recovery_and_replay(spark, tmp_path):
    row = lambda key, mood: (key, "甲", "annotated", mood, 3, 1, "{}")
    path = str(tmp_path / "recovery")
    files.write_recovery(spark.createDataFrame([row(101, "positive"), row(201, "neutral")], SENTIMENT_SCHEMA), path)
    files.write_recovery(spark.createDataFrame([row(101, "negative")], SENTIMENT_SCHEMA), path)
    (tmp_path / "recovery" / "shard=01" / "extra.json").write_text("\n{broken\n")
    back, malformed = files.read_recovery(spark, path, SENTIMENT_SCHEMA)
    assert sorted(r.comment_id for r in back.collect()) == [101, 101, 201]
    assert [r.malformed for r in malformed.collect()] == ["{broken"]
    table = tables.KeyedTable(spark, str(tmp_path / "sentiment"), ["comment_id", "method"], "written_at")
    table.create(back.filter("comment_id = 201"))
    assert files.replay(table, back).count() == 0
    assert {r.comment_id: r.polarity for r in table.read().collect()} == {101: "negative", 201: "neutral"}


def test_child_replace(spark):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], ["comment_id", "aspect"])
    new = spark.createDataFrame([(1, "z")], ["comment_id", "aspect"])
    parents = spark.createDataFrame([(1,), (2,)], ["comment_id"])
    assert [tuple(r) for r in tables.replace_children(old, new, parents, "comment_id").collect()] == [(1, "z")]
