"""Exact CSV files, header contract, union of pools, isolation of failing texts."""

import glob
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.operators import annotation
from cairn.schema import CLEANED_CSV_SCHEMA, DERIVED_COLUMNS, SOURCE_HEADER
from cairn.sinks import files, tables
from cairn.sources import reviews

NAMES = CLEANED_CSV_SCHEMA.fieldNames()
COLUMNS = [n for _, n in SOURCE_HEADER] + [n for n, _ in DERIVED_COLUMNS]


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["plain", 'a "quoted", text', "two\nlines", "two\r\nlines", " blanks ", None, ",", "é 水"]
    data = [(i, texts[i % len(texts)]) for i in range(40)]
    df = spark.createDataFrame(data, "comment_id bigint, content string")
    kinds = {n: CLEANED_CSV_SCHEMA[h].dataType for h, n in SOURCE_HEADER} | dict(DERIVED_COLUMNS)
    return df.select(*[F.col(c) if c in ("comment_id", "content") else F.lit("2024-01-02").cast("date").alias(c) if c == "publish_date"
                       else F.lit(None).cast(kinds[c]).alias(c) for c in COLUMNS]).repartition(3)


def test_every_file_has_mark_header_and_line_ends(spark, rows, tmp_path):
    path = str(tmp_path / "csv")
    files.write_exact_csv(rows.withColumn("extra", F.lit(1)), path)
    parts = [open(f, "rb").read() for f in glob.glob(f"{path}/part-*")]
    head = b"\xef\xbb\xbf" + ",".join(NAMES).encode() + b"\r\n"
    assert len(parts) > 1 and all(p.startswith(head) and p.count(head[3:]) == 1 and p.endswith(b"\r\n") for p in parts)
    records = b"".join(p[len(head):] for p in parts)
    assert b',"a ""quoted"", text",' in records and b',"two\r\nlines",' in records and b', blanks ,' in records and b",plain," in records
    back = reviews.read_cleaned_csv(spark, path)
    kept = lambda df: Counter(map(tuple, df.filter("content not like '% blanks %' or content is null").select("comment_id", "content", "publish_date").collect()))
    # Spark's CSV reader gives a quoted CR LF back as LF.
    assert kept(back) == kept(rows.withColumn("content", F.regexp_replace("content", "\r\n", "\n"))) and back.count() == 40
    with pytest.raises(Exception):
        files.write_exact_csv(rows, path)
    files.write_exact_csv(rows.filter("false"), path, force=True)
    assert [open(f, "rb").read() for f in glob.glob(f"{path}/part-*")] == [head]
    assert reviews.read_cleaned_csv(spark, path).count() == 0


def test_headers_of_all_files(spark, tmp_path):
    expected, lines = ["a", "b,c", "d"], {
        "good": 'a,"b,c",d\n1,2,3\n', "marked": '﻿a,"b,c",d\r\n1,2,3\r\n', "fewer": 'a,"b,c"\n', "more": 'a,"b,c",d,e\n', "swapped": '"b,c",a,d\n',
        "blank": 'a,,d\n', "long": 'a,"b,c",x' + ",y" * 50 + "\n" + "z\n" * 1000, "empty": ""}
    for name, text in lines.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    found = reviews.header_deviations(reviews.file_headers(spark, str(tmp_path)), expected).collect()
    got = {r.file.rsplit("/", 1)[1][:-4]: (r.columns, r.position, r.found, r.wanted) for r in found}
    assert got == {"fewer": (2, 2, None, "d"), "more": (4, 3, "e", None), "swapped": (3, 0, "b,c", "a"), "blank": (3, 1, "", "b,c"), "long": (8, 2, "x", "d")}
    for name in ("good", "marked"):
        reviews.check_header(spark, str(tmp_path / f"{name}.csv"), expected)
    for name, said in (("fewer", "expected 3 columns, found 2"), ("swapped", "column 0 is 'b,c'"), ("empty", "empty")):
        with pytest.raises(ValueError, match=said):
            reviews.check_header(spark, str(tmp_path / f"{name}.csv"), expected)


def test_first_pool_wins(spark):
    rng, pools, want = random.Random(2), [], {}
    for name in "xyz":
        data = {rng.choice([None, *range(30)]): (name, rng.choice([None, 1, 2])) for _ in range(15)}
        pools.append([(k, *v) for k, v in data.items()])
        for k, v in data.items():
            want.setdefault(k, v)
    frames = [spark.createDataFrame(p, "id bigint, pool string, v int").repartition(2) for p in pools]
    frames[1] = frames[1].withColumn("more", F.lit(1))
    assert {r.id: (r.pool, r.v) for r in tables.precedence_union(frames, ["id"]).collect()} == want
    twice = spark.createDataFrame([(1, "b", 2), (1, "a", 9), (1, "a", 9)], "id bigint, pool string, v int")
    assert [tuple(r) for r in tables.precedence_union([frames[0].filter("false"), twice], ["id"]).collect()] == [(1, "a", 9)]
    assert tables.precedence_union([frames[0].filter("false")], ["id"]).count() == 0


# --- failing texts --------------------------------------------------------------------------------------

def test_only_guilty_texts_fail_and_calls_are_few():
    calls = []

    def annotate(texts):
        calls.append(len(texts))
        if texts.str.contains("bad").any():
            raise RuntimeError("refused")
        return [{"raw_text": t} for t in texts]

    texts = pd.Series([f"t{i}" for i in range(64)])
    texts[[5, 40]] = "bad"
    answers, tried = annotation._answers(annotate, texts, 1, 1)
    assert [i for i, a in enumerate(answers) if isinstance(a, RuntimeError)] == [5, 40]
    assert all(a["raw_text"] == texts[i] for i, a in enumerate(answers) if i not in (5, 40))
    assert len(calls) == 1 + 2 * 2 * 6 - 2 and tried[5] == 7 and tried[63] == 3


def test_single_texts_are_tried_again():
    left = {"flaky": 2}

    def annotate(texts):
        if texts.iloc[0] in left and left[texts.iloc[0]]:
            left[texts.iloc[0]] -= 1
            raise TimeoutError("late")
        return [{"raw_text": t} for t in texts]

    assert annotation._answers(annotate, pd.Series(["flaky"]), 1, 3) == ([{"raw_text": "flaky"}], [3])
    left["flaky"] = 9
    answers, tried = annotation._answers(annotate, pd.Series(["flaky"]), 1, 3)
    assert isinstance(answers[0], TimeoutError) and tried == [3]


def test_annotator_job_loses_only_the_breaking_row(spark):
    def annotate(texts):
        if (texts == "bad").any():
            raise RuntimeError("refused")
        return [{"raw_text": t, "prompt_tokens": 1} for t in texts] + ([{}] if (texts == "long").any() else [])

    data = [(i, "甲", {7: "bad", 8: "long", 9: None}.get(i, f"t{i}")) for i in range(30)]
    df = spark.createDataFrame(data, "comment_id bigint, spot_name string, content string")
    out = annotation.run_annotator(df, annotate, partitions=2, batch_rows=8).collect()
    assert {r.comment_id: r.error_kind for r in out if r.error_kind} == {7: "RuntimeError", 8: "ValueError"}
    assert len(out) == 30 and all(r.raw_text == r.content and r.prompt_tokens == 1 for r in out if not r.error_kind and r.content)
    assert annotation.run_annotator(df.filter("false"), annotate).count() == 0
