"""Question routing over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.binding import let
from cairn.functions.skew import key_sizes, salted_lookup_join
from cairn.functions.text import contains_any, strip
from cairn.operators.linking import link_entities, question_text
from cairn.operators.numbers import numbers_in
from cairn.operators.opinions import aspect_statistics, sentiment_distribution
from cairn.operators.statistics import score_distribution
from cairn.rules import (
    DEFAULT_RULES, OUT_OF_SCOPE_WORDS, POLARITIES, QUESTION_KEYWORDS, Rules, caliber_notes,
)

OUT_OF_SCOPE = "OUT_OF_SCOPE"
NEEDS_SPOT = ("SPOT_EVALUATION", "VISITOR_FOCUS", "SENTIMENT_EXPLAIN")
SPOTS_USED = {"SPOT_EVALUATION": 2, "SPOT_COMPARISON": 2, "VISITOR_FOCUS": 1, "SENTIMENT_EXPLAIN": 1}
MAX_ITEMS, MAX_CHARS = 30, 3000
MAX_RANKED = 20


def question_type(text: Column) -> Column:
    """Out-of-scope words first, then the keyword lists in order, else out of scope."""
    kind = F.lit(OUT_OF_SCOPE)
    for name, words in reversed(QUESTION_KEYWORDS):
        kind = F.when(contains_any(text, words), name).otherwise(kind)
    return F.when((text == "") | contains_any(text, OUT_OF_SCOPE_WORDS), OUT_OF_SCOPE).otherwise(kind)


def classify(questions: DataFrame) -> DataFrame:
    """(question_id, text, question_type)."""
    both = let(question_text(), lambda t: F.struct(t.alias("text"), question_type(t).alias("question_type")))
    return questions.select("question_id", both.alias("q")).select("question_id", "q.text", "q.question_type")


def ranking_size(text: Column) -> Column:
    """How many places a ranking question asks for: named tens first, then 3…20, default 10."""
    n = F.lit(10)
    for i in range(MAX_RANKED, 2, -1):
        hit = F.lower(text).contains(f"top{i}") | text.contains(f"前{i}")
        n = F.when(hit, i).otherwise(n)
    for token, value in (("前二十", 20), ("前三", 3), ("前五", 5), ("前十", 10)):
        n = F.when(text.contains(token), value).otherwise(n)
    return n


# --- fact items ---------------------------------------------------------------------------------
# Every retrieval plan yields rows (spot_name or NULL, block_no, item_no, source, title, item), the
# item already written as the JSON text that the length budget counts.

def _item(*pairs: tuple[str, Column]) -> Column:
    """One item as JSON text: ``{"name": value, ...}`` with null for missing values."""
    parts = [F.lit("{")]
    for i, (name, value) in enumerate(pairs):
        parts += [F.lit((", " if i else "") + f'"{name}": '), F.coalesce(value, F.lit("null"))]
    return F.concat(*parts, F.lit("}"))


def _text(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _num(c: Column) -> Column:
    return c.cast("string")


def _measure(label: str, value: Column) -> Column:
    return _item(("指标", F.lit(f'"{label}"')), ("值", _num(value)))


def _listed(rows: DataFrame, kind: str, block_no: int, source: str, title: Column, items: list[Column]) -> DataFrame:
    return rows.select(
        F.lit(kind).alias("question_type"), "spot_name", F.lit(block_no).alias("block_no"),
        F.lit(source).alias("source"), title.alias("title"),
        F.posexplode(F.array_compact(F.array(*items))).alias("item_no", "item"),
    )


def _ranked(rows: DataFrame, kind: str, block_no: int, source: str, title: Column, order: list[Column],
            item: Column, limit: int, first: int = 0) -> DataFrame:
    """Items numbered by order within an entity; at most one row per aspect or polarity."""
    rank = F.row_number().over(W.partitionBy("spot_name").orderBy(*order))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= limit).select(
        F.lit(kind).alias("question_type"), "spot_name", F.lit(block_no).alias("block_no"),
        F.lit(source).alias("source"), title.alias("title"),
        (F.col("_r") - 1 + first).alias("item_no"), item.alias("item"),
    )


def spot_fact_items(stats: DataFrame, reports: DataFrame, sentiment: DataFrame, aspects: DataFrame,
                    semantic: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """N2 for the four entity-bound types: items per entity, a few dozen rows each."""
    shares = aspect_statistics(aspects, rules=rules)
    name = F.col("spot_name")
    enough = F.col("conclusive") == 1
    notes = reports.select("spot_name", "summary", "need_review")
    basics = stats.join(notes, "spot_name", "left")
    evaluation = _listed(basics, "SPOT_EVALUATION", 0, "stat_spot, spot_report",
                         F.concat(name, F.lit(" 的统计与评价")), [
        _measure("评论量", F.col("review_count")), _measure("平均评分", F.col("avg_score")),
        _measure("好评率（4-5 星占比）", F.col("positive_rate")),
        _measure("差评率（1-2 星占比）", F.col("negative_rate")),
        F.when(F.col("summary").isNotNull(),
               _item(("指标", F.lit('"已生成的智能评价（离线）"')), ("值", _text(F.col("summary"))))),
        F.when(F.col("need_review") == 1,
               _item(("指标", F.lit('"数据说明"')), ("值", F.lit('"部分数字已核对，建议结合样本量判断"')))),
    ])
    compared = F.concat(name, F.lit(" 的指标与方面"))
    comparison = _listed(stats, "SPOT_COMPARISON", 0, "stat_spot, aspect", compared, [
        _measure("评论量", F.col("review_count")), _measure("平均评分", F.col("avg_score")),
        _measure("好评率", F.col("positive_rate")),
    ]).unionByName(_ranked(
        shares, "SPOT_COMPARISON", 0, "stat_spot, aspect", compared,
        [F.desc("sample_size"), F.asc("aspect_name")],
        _item(("方面", _text(F.col("aspect_name"))), ("样本量", _num(F.col("sample_size"))),
              ("正面占比", _num(F.col("positive_rate"))), ("负面占比", _num(F.col("negative_rate"))),
              ("说明", F.when(~enough, _text(F.col("note"))))),
        8, first=3,
    ))
    focus = _ranked(
        shares, "VISITOR_FOCUS", 0, "aspect", F.lit("该景点游客提及最多的方面"),
        [F.desc("sample_size"), F.asc("aspect_name")],
        _item(("方面", _text(F.col("aspect_name"))), ("提及样本量", _num(F.col("sample_size"))),
              ("负面占比", _num(F.col("negative_rate")))),
        15,
    )
    words = (
        semantic.filter(F.coalesce("keywords", F.lit("")) != "")
        .select("spot_name", F.explode(F.transform(F.split("keywords", ","), strip)).alias("keyword"))
        .filter(F.col("keyword") != "").groupBy("spot_name", "keyword").agg(F.count(F.lit(1)).alias("n"))
    )
    keywords = _ranked(
        words, "VISITOR_FOCUS", 1, "comment_semantic.keywords", F.lit("语义分析提取的高频关键词"),
        [F.desc("n"), F.asc("keyword")],
        _item(("关键词", _text(F.col("keyword"))), ("出现条数", _num(F.col("n")))), 15,
    )
    mood = sentiment_distribution(sentiment, rules=rules)
    moods = _listed(mood, "SENTIMENT_EXPLAIN", 0, "sentiment", F.lit("该景点情感分布"), [
        F.when(F.col(f"{p}_n") > 0,
               _item(("极性", F.lit(f'"{p}"')), ("条数", _num(F.col(f"{p}_n"))), ("占比", _num(F.col(f"{p}_rate")))))
        for p in POLARITIES
    ])
    worst = _ranked(
        shares.filter(enough), "SENTIMENT_EXPLAIN", 1, "aspect", F.lit("负面倾向最明显的方面"),
        [F.desc(F.col("negative_n") / F.col("sample_size")), F.asc("aspect_name")],
        _item(("方面", _text(F.col("aspect_name"))), ("样本量", _num(F.col("sample_size"))),
              ("负面占比", _num(F.col("negative_rate")))), 10,
    )
    parts = [comparison, focus, keywords, moods, worst]
    out = evaluation
    for part in parts:
        out = out.unionByName(part)
    return out


def metric_items(reviews: DataFrame, spots: DataFrame, origins: DataFrame) -> DataFrame:
    """Dataset totals, score distribution, valid origin sample: about a dozen rows."""
    kind = "DATA_METRIC"
    totals = reviews.agg(
        F.count(F.lit(1)).alias("n"), F.count("score").alias("scored"),
        F.count_if(F.col("is_low_info") == 1).alias("low"), F.count_if(F.col("is_dup_content") == 1).alias("dup"),
    ).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("item_no"), _measure(label, F.col(c)).alias("item"))
        for i, label, c in ((0, "评论总数", "n"), (2, "有评分评论数", "scored"),
                            (3, "低信息量评论数", "low"), (4, "重复正文评论数", "dup"))
    ])).alias("i")).select("i.*")
    spot_total = spots.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(1).alias("item_no"), _measure("景点总数", F.col("n")).alias("item"))
    size = totals.unionByName(spot_total).select(
        F.lit(0).alias("block_no"), F.lit("review, spot").alias("source"), F.lit("数据集规模").alias("title"),
        "item_no", "item")
    stars = score_distribution(reviews).select(
        F.lit(1).alias("block_no"), F.lit("review.score").alias("source"), F.lit("评分分布").alias("title"),
        (5 - F.col("score")).alias("item_no"),
        _item(("星级", _text(F.concat(_num(F.col("score")), F.lit(" 星")))), ("条数", _num(F.col("n"))),
              ("占比", _num(F.col("rate")))).alias("item"))
    sample = origins.filter(F.col("scope_type") == "global").agg(
        F.coalesce(F.max("sample_size"), F.lit(0)).alias("n")).select(
        F.lit(2).alias("block_no"), F.lit("stat_ip").alias("source"), F.lit("客源地有效样本").alias("title"),
        F.lit(0).alias("item_no"), _measure("有效 IP 样本量", F.col("n")).alias("item"))
    return size.unionByName(stars).unionByName(sample).select(
        F.lit(kind).alias("question_type"), F.lit(None).cast("string").alias("spot_name"), "*")


def ranking_items(stats: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The twenty most reviewed entities; a question takes its first N."""
    top = stats.filter(F.col("review_count") >= rules.ranking_min_reviews).orderBy(
        F.desc("review_count"), "spot_name").limit(MAX_RANKED)
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("review_count"), F.asc("spot_name")))
    return top.withColumn("place", place).select(
        F.lit("RANKING").alias("question_type"), F.lit(None).cast("string").alias("spot_name"),
        F.lit(0).alias("block_no"), F.lit("stat_spot").alias("source"), F.lit("评论量排行").alias("title"),
        (F.col("place") - 1).alias("item_no"),
        _item(("排名", _num(F.col("place"))), ("景点", _text(F.col("spot_name"))),
              ("评论量", _num(F.col("review_count"))), ("平均评分", _num(F.col("avg_score")))).alias("item"))


def retrieve(classified: DataFrame, linked: DataFrame, spot_items: DataFrame, global_items: DataFrame,
             rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(question_id, block_no, item_no, source, title, item) for every answerable question.

    Entity items are looked up by (type, entity) with salted keys, since one popular entity may be
    in a large share of the questions.  ``global_items`` is the output of ``metric_items`` and
    ``ranking_items``: at most five stars, six totals and twenty places, hence the broadcast.
    """
    used = F.create_map(*[F.lit(x) for pair in SPOTS_USED.items() for x in pair])[F.col("question_type")]
    mentions = classified.select("question_id", "question_type").join(linked, "question_id")
    counts = linked.groupBy("question_id").agg(F.count(F.lit(1)).alias("linked"))
    mentions = mentions.join(counts, "question_id").filter(
        (F.col("mention_no") <= used) & ~((F.col("question_type") == "SPOT_COMPARISON") & (F.col("linked") < 2))
    )
    keys = ["question_type", "spot_name"]
    mentions = mentions.select("question_id", *keys, "mention_no")
    own = salted_lookup_join(
        mentions, spot_items, key_sizes(mentions, keys), keys, "question_id", rules.hot_key_rows, "inner",
    ).select("question_id", (F.col("mention_no") * 10 + F.col("block_no")).alias("block_no"),
             "item_no", "source", "title", "item")
    wide = classified.join(F.broadcast(global_items), "question_type").filter(
        (F.col("question_type") != "RANKING") | (F.col("item_no") < ranking_size(F.col("text")))
    ).select("question_id", "block_no", "item_no", "source", "title", "item")
    return own.unionByName(wide)


def context_budget(facts: DataFrame, max_items: int = MAX_ITEMS, max_chars: int = MAX_CHARS) -> DataFrame:
    """The prefix of each question's facts that fits the item and character limits.

    A question has at most a few dozen facts, so its window partition is small.
    """
    order = W.partitionBy("question_id").orderBy("block_no", "item_no", "item")
    running = F.sum(F.length("item")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    place = F.row_number().over(order)
    return (
        facts.withColumns({"position": place, "used_chars": running})
        .filter((F.col("position") <= max_items) & (F.col("used_chars") <= max_chars))
    )


def question_caliber(kind: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """BR-10: the note that travels with an answer of this type."""
    n = caliber_notes(rules)
    return (
        F.when(kind == "SPOT_COMPARISON", n["threshold"] + " " + n["aspect"])
        .when(kind.isin("VISITOR_FOCUS", "SENTIMENT_EXPLAIN"), n["aspect"] + " " + n["sentiment"])
        .when(kind == "DATA_METRIC", n["origin"] + " " + n["trend"])
        .when(kind.isin("SPOT_EVALUATION", "RANKING"), n["threshold"])
    )


def decide_branch(classified: DataFrame, linked: DataFrame, facts: DataFrame) -> DataFrame:
    """Outcome per question and whether an answered one would be recorded."""
    mentions = linked.groupBy("question_id").agg(F.count(F.lit(1)).alias("spots"))
    found = facts.groupBy("question_id").agg(F.count(F.lit(1)).alias("facts"))
    kind = F.col("question_type")
    spots, n = F.coalesce("spots", F.lit(0)), F.coalesce("facts", F.lit(0))
    branch = (
        F.when(F.col("text") == "", "EMPTY_QUESTION")
        .when(kind == OUT_OF_SCOPE, OUT_OF_SCOPE)
        .when(kind.isin(*NEEDS_SPOT) & (spots == 0), "SPOT_NOT_RECOGNIZED")
        .when((kind == "SPOT_COMPARISON") & (spots < 2), "NEED_TWO_SPOTS")
        .when(n == 0, "NO_DATA").otherwise("ANSWERABLE")
    )
    return (
        classified.join(mentions, "question_id", "left").join(found, "question_id", "left")
        .select("question_id", "question_type", spots.alias("spots"), n.alias("facts"), branch.alias("branch"))
        .withColumn("is_recorded", (F.col("branch") == "ANSWERABLE").cast("int"))
    )


NOT_RECORDED = (
    "SPOT_NOT_RECOGNIZED", "NEED_TWO_SPOTS", "NO_DATA", "EMPTY_QUESTION",
    "LLM_FAILED", "LLM_BAD_FORMAT", "LIVE_DISABLED", "API_KEY_MISSING",
)


def recorded(outcomes: DataFrame) -> DataFrame:
    """Outcomes (question_type, reason) that are kept as records."""
    return outcomes.filter(
        (F.col("question_type") != OUT_OF_SCOPE) & ~F.coalesce("reason", F.lit("")).isin(*NOT_RECORDED)
    )


def quotable_numbers(context: DataFrame, classified: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Numbers an answer may use: those of its context items and of its caliber note."""
    per_question = context.groupBy("question_id").agg(
        F.flatten(F.collect_list(numbers_in(F.col("item")))).alias("numbers"))
    note = numbers_in(question_caliber(F.col("question_type"), rules))
    return classified.select("question_id", note.alias("note_numbers")).join(per_question, "question_id").select(
        "question_id", F.concat("numbers", "note_numbers").alias("facts"))


def route(questions: DataFrame, spots: DataFrame, spot_items: DataFrame, global_items: DataFrame,
          rules: Rules = DEFAULT_RULES) -> DataFrame:
    """N1-N5 in one: the budgeted context rows of every answerable question."""
    classified = classify(questions)
    linked = link_entities(questions, spots)
    return context_budget(retrieve(classified, linked, spot_items, global_items, rules))
