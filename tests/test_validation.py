"""Golden cases for annotator output, rule labels and number checks."""

import json

import pytest
from pyspark.sql import functions as F

from cairn.operators import annotation, numbers, validation
from cairn.rules import ASPECTS, Rules

TEXT = "布局　很好 风景漂亮，但是排队太久，门票贵"


def check(spark, *raws, content=TEXT):
    rows = spark.createDataFrame([(i, r, content) for i, r in enumerate(raws)], "comment_id long, raw_text string, content string")
    return validation.validate_annotations(rows).orderBy("comment_id").collect()


def body(**fields):
    return json.dumps(fields, ensure_ascii=False)


def test_json_body_and_enum(spark):
    good = body(polarity=" Positive ", intensity=9, aspects=[], keywords=["漂亮", "漂亮", " ", "一二三四五六七八九十百"], summary="好")
    fenced, prose, bad, listed, odd = check(
        spark, f"```json\n{good}\n```", f"结果：{good} 完毕", "不是 JSON", "[1, 2]", good + " {x}")
    assert (fenced.is_usable, fenced.polarity, fenced.intensity, fenced.is_valid) == (True, "positive", 5, 1)
    assert fenced.keywords == "漂亮,一二三四五六七八九十" and prose.summary == "好"
    assert not bad.is_usable and not listed.is_usable and not odd.is_usable


@pytest.mark.parametrize("value, expected", [(4.5, 4), (5.5, 5), (-3, 1), ("4分", 4), ("无", None), (True, None), (None, None)])
def test_intensity(spark, value, expected):
    assert check(spark, body(polarity="great", intensity=value))[0].intensity == expected


def test_illegal_polarity_becomes_neutral(spark):
    row = check(spark, body(polarity="great"))[0]
    assert (row.polarity, row.is_valid) == ("neutral", 0) and row.validation_reason


def test_aspects(spark):
    items = [
        {"aspect": "风景", "polarity": "positive", "evidence": "布局很好"},        # whitespace differs
        {"aspect": "风景", "polarity": "positive", "evidence": "风景漂亮"},
        {"aspect": "位置", "polarity": "positive", "evidence": "风景漂亮"},
        {"aspect": "门票", "polarity": "odd", "evidence": "门票贵"},
        {"aspect": "服务", "polarity": "negative", "evidence": "服务很差"},
        "文字",
        {"aspect": "人流拥挤", "polarity": "NEGATIVE", "evidence": "排队太久"},
    ]
    row = check(spark, body(polarity="negative", aspects=items))[0]
    assert [(a.aspect, a.polarity) for a in row.aspects] == [("风景", "positive"), ("人流拥挤", "negative")]
    assert [d.reason for d in row.dropped_aspects] == [
        "duplicate_aspect", "unknown_aspect", "illegal_polarity", "evidence_not_in_text", "not_an_object"]


def test_aspect_limit_and_shape(spark):
    many = [{"aspect": a, "polarity": "neutral", "evidence": "风景"} for a in ASPECTS[:7]]
    limited, no_list = check(spark, body(polarity="neutral", aspects=many), body(polarity="neutral", aspects="风景"))
    assert len(limited.aspects) == 5 and [d.reason for d in limited.dropped_aspects] == ["over_limit"] * 2
    assert [d.reason for d in no_list.dropped_aspects] == ["aspects_not_a_list"]


def test_rule_labels(spark):
    rows = spark.createDataFrame([(1, "甲", "很美 值得"), (2, "甲", "太贵"), (3, "甲", "很美但贵"), (4, "甲", "一般")],
                                 "comment_id long, spot_name string, content string")
    got = {r.comment_id: (r.polarity, r.intensity, r.keywords) for r in annotation.rule_labels(rows).collect()}
    assert got == {1: ("positive", 3, "值得,很美"), 2: ("negative", 3, "贵"), 3: ("neutral", None, "很美,贵"), 4: ("neutral", None, None)}


def test_annotator_reads_the_text(spark):
    rules = Rules(aspect_words=(("风景", ("湖", "山")), ("门票", ("票",))))
    rows = spark.createDataFrame([(1, "甲", " 山很美，票贵"), (2, "甲", "值得，票"), (3, "甲", None)], "comment_id long, spot_name string, content string")
    got = {r.comment_id: json.loads(r.raw_text) for r in annotation.read_responses(rows, rules).collect()}
    assert got[1] == {"polarity": "neutral", "aspects": [{"aspect": "风景", "polarity": "neutral", "evidence": "山"}, {"aspect": "门票", "polarity": "neutral", "evidence": "票"}],
                      "keywords": ["很美", "贵"], "summary": "山很美，票贵"}
    assert (got[2]["polarity"], got[2]["intensity"], got[3]["aspects"]) == ("positive", 3, [])
    checked = validation.validate_annotations(annotation.read_responses(rows, rules), rules)
    assert checked.selectExpr("sum(size(aspects))", "sum(size(dropped_aspects))").first()[:] == (3, 0)


def test_failing_text_is_a_row(spark):
    rows = spark.createDataFrame([(1, "甲", "好"), (2, "甲", "坏")], "comment_id long, spot_name string, content string")

    def annotate(texts):
        return [ValueError("no") if t == "坏" else {"raw_text": "{}", "total_tokens": 3} for t in texts]

    out = annotation.run_annotator(rows, annotate)
    assert out.filter("error_kind is null").count() == 1
    assert annotation.failure_rows(out).first().message == "[ValueError] no"


def test_report_numbers(spark):
    rows = spark.createDataFrame(
        [("共 3965 条，好评率 87.4%，均分 4.6", [], [], [], [87.8], [3965.0, 4.6]),
         ("好评率 88.4％，约 120 条，2 个方面", [], [], [], [87.8], [3965.0]),
         ("占 60 个百分点", [], [], [], [], [])],
        "summary string, advantages array<string>, issues array<string>, visitor_focus array<string>, "
        "percent_facts array<double>, plain_facts array<double>")
    got = [(r.percent_mismatches, r.number_mismatches, r.need_review) for r in numbers.check_report_numbers(rows).collect()]
    assert got == [([], [], 0), ([88.4], [120.0], 1), ([], [], 0)]


def test_comparison_numbers(spark):
    df = spark.createDataFrame([("相差 3,965 条，占 87.82%，另有 777 条", [3965.0, 0.8782])], "t string, f array<double>")
    # A value within 0.5 of a fact counts as matched, also after dividing by one hundred.
    assert df.select(numbers.unmatched_tokens(F.col("t"), F.col("f"))).first()[0] == ["777"]


@pytest.mark.parametrize("answer, review", [
    ("共 3,965 条。", 0), ("共 9,999 条。", 1), ("以 4-5 星为主", 0), ("共 3,965条", 1), ("第 2 项", 0)])
def test_answers(spark, answer, review):
    df = spark.createDataFrame([(answer, [3965.0])], "answer string, facts array<double>")
    assert numbers.validate_answers(df).first().need_review == review


def test_answer_boundary_and_length(spark):
    df = spark.createDataFrame([("可以订票",), ("很" * 700,)], "answer string").withColumn("facts", F.array().cast("array<double>"))
    first, second = numbers.validate_answers(df).collect()
    assert first.boundary_words == ["订票"] and first.checked_answer.startswith("可以订票 （")
    assert second.was_cut and len(second.checked_answer) == 600


def test_reports_and_comparisons(spark):
    report = body(summary="x" * 300, advantages=["a", "", "b"], issues=[str(i) for i in range(9)], visitor_focus="?")
    rows = spark.createDataFrame([(report,), (body(summary=" "),)], "raw_text string")
    ok, empty = validation.validate_reports(rows).collect()
    assert (ok.is_usable, len(ok.summary), ok.advantages, len(ok.issues), ok.visitor_focus) == (True, 260, ["a", "b"], 6, [])
    assert ok.repairs == ["summary cut", "issues cut", "visitor_focus short"] and not empty.is_usable
    texts = spark.createDataFrame([(body(differences=["甲优于乙"], possible_reasons=[]),), (body(differences=[]),)], "raw_text string")
    verdict, nothing = validation.validate_comparisons(texts).collect()
    assert verdict.verdict_words == ["优于"] and verdict.is_usable and not nothing.is_usable


def test_evidence_violations(spark):
    aspects = spark.createDataFrame([(1, "风景", "布局很好"), (1, "门票", "编造"), (1, "服务", "门票贵")],
                                    "comment_id long, aspect_name string, evidence string")
    reviews = spark.createDataFrame([(1, TEXT)], "comment_id long, content string")
    got = {r.aspect_name: r.violation for r in validation.evidence_violations(aspects, reviews).collect()}
    assert got == {"风景": "whitespace_only", "门票": "genuine"}
