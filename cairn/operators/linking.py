"""Entity mentions in questions (N4, J15, W6) without comparing every question with every name.

A name is found by its whole text or, failing that, by its longest prefix of three or more
characters that occurs in the question.  Names are expanded to their prefixes once; a question is
expanded only at positions whose first characters start some name.  Both expansions meet in equi
joins, so cost follows the real hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.session import cut_lineage

MIN_NAME, MIN_PREFIX = 2, 3
_NOT_FOUND = 10**6

_SPAN = "array<struct<token:string,spot_name:string,s:int,e:int>>"


def name_prefixes(spots: DataFrame) -> DataFrame:
    """(prefix, child, best entity): child is the next longer prefix, NULL for a whole name.

    Of the names below one child only the most reviewed matters: the others would claim the same
    characters.  The aggregate keeps that one, so a prefix shared by very many names stays one
    row per following character.
    """
    names = spots.filter(F.length("spot_name") >= MIN_NAME).select("spot_name", "review_count")
    cuts = F.when(
        F.length("spot_name") > MIN_PREFIX, F.sequence(F.lit(MIN_PREFIX), F.length("spot_name"))
    ).otherwise(F.array(F.length("spot_name")))
    cut = F.col("cut")
    whole = cut == F.length("spot_name")
    return (
        names.withColumn("cut", F.explode(cuts))
        .select(
            F.substr("spot_name", F.lit(1), cut).alias("prefix"),
            F.when(~whole, F.substr("spot_name", F.lit(1), cut + 1)).alias("child"),
            "spot_name", "review_count",
        )
        .groupBy("prefix", "child")
        # Most reviews first, then the smaller name.
        .agg(F.min(F.struct((-F.coalesce("review_count", F.lit(0))).alias("neg"), "spot_name")).alias("best"))
        .select("prefix", "child", F.col("best.spot_name").alias("spot_name"),
                (-F.col("best.neg")).alias("review_count"))
    )


def question_text() -> Column:
    return strip(F.coalesce("question", F.lit("")))


def matched_prefixes(questions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(question_id, text, prefix): the name prefixes that occur in each question."""
    text = F.col("text")
    # No prefix is longer than the longest name, which bounds the growth at each position.
    longest = prefixes.agg(F.max(F.length("prefix"))).first()[0] or MIN_PREFIX
    starts = questions.select("question_id", question_text().alias("text")).filter(F.length("text") >= MIN_NAME).select(
        "question_id", "text", F.explode(F.sequence(F.lit(1), F.length("text") - MIN_NAME + 1)).alias("at")
    )
    heads = prefixes.select(F.substring("prefix", 1, MIN_PREFIX).alias("head")).distinct()
    # A three-character head opens the position; two-character names are their own head.
    opened = starts.select(
        "question_id", "text", "at",
        F.explode(F.array_distinct(F.array(*[F.substr(text, F.col("at"), F.lit(n)) for n in (MIN_NAME, MIN_PREFIX)])))
        .alias("head"),
    ).join(heads, "head", "left_semi").select("question_id", "text", "at", F.length("head").alias("size"))
    grown = opened.select(
        "question_id", "text",
        F.explode(F.when(F.col("size") < MIN_PREFIX, F.array(F.substr(text, F.col("at"), F.col("size")))).otherwise(
            F.transform(
                F.sequence(F.lit(MIN_PREFIX), F.least(F.length(text) - F.col("at") + 1, F.lit(longest))),
                lambda n: F.substr(text, F.col("at"), n),
            )
        )).alias("prefix"),
    ).distinct()
    return grown.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")


def mention_candidates(questions: DataFrame, spots: DataFrame) -> DataFrame:
    """(question_id, text, token, spot_name, review_count, is_whole), best entity per token."""
    prefixes = name_prefixes(spots)
    matched = cut_lineage(matched_prefixes(questions, prefixes))
    # A name is a candidate through its longest matched prefix: its next prefix must not match.
    hits = matched.join(prefixes, "prefix")
    longer = matched.select("question_id", F.col("prefix").alias("child"))
    last = hits.join(longer, ["question_id", "child"], "left_anti")
    rank = F.struct(F.col("child").isNotNull().cast("int").alias("partial"),
                    (-F.coalesce("review_count", F.lit(0))).alias("neg"), "spot_name")
    return last.groupBy("question_id", "text", F.col("prefix").alias("token")).agg(F.min(rank).alias("b")).select(
        "question_id", "text", "token", "b.spot_name", (-F.col("b.neg")).alias("review_count"),
        (F.col("b.partial") == 0).cast("int").alias("is_whole"),
    )


def link_entities(questions: DataFrame, spots: DataFrame, limit: int = 5) -> DataFrame:
    """(question_id, spot_name, mention_no): non-overlapping mentions in reading order.

    Priority is whole name, longer token, more reviews, earlier position; a token that touches an
    accepted span is skipped.  The fold runs over the distinct tokens of one question.
    """
    found = mention_candidates(questions, spots)
    start = F.instr("text", F.col("token"))
    entry = F.struct(
        (1 - F.col("is_whole")).alias("o1"), (-F.length("token")).alias("o2"), (-F.col("review_count")).alias("o3"),
        start.alias("s"), (start + F.length("token")).alias("e"), "token", "spot_name",
    )
    lists = found.groupBy("question_id", "text").agg(F.array_sort(F.collect_list(entry)).alias("c"))

    def step(kept: Column, item: Column) -> Column:
        clash = F.exists(kept, lambda k: (item["s"] < k["e"]) & (k["s"] < item["e"]))
        names = F.array_distinct(F.transform(kept, lambda k: k["spot_name"]))
        add = F.array(F.struct(item["token"].alias("token"), item["spot_name"].alias("spot_name"),
                               item["s"].alias("s"), item["e"].alias("e"))).cast(_SPAN)
        return F.when(clash | (F.size(names) >= limit), kept).otherwise(F.concat(kept, add))

    kept = F.aggregate("c", F.array().cast(_SPAN), step)
    names = F.array_distinct(F.transform(kept, lambda k: k["spot_name"]))

    def position(name: Column) -> Column:
        by_name, by_head = F.instr(F.col("text"), name), F.instr(F.col("text"), F.substring(name, 1, MIN_PREFIX))
        return F.when(by_name > 0, by_name).when(by_head > 0, by_head).otherwise(_NOT_FOUND)

    ordered = F.array_sort(F.transform(
        names, lambda n: F.struct(position(n).alias("p"), F.array_position(names, n).alias("i"), n.alias("spot_name"))
    ))
    return lists.select("question_id", F.posexplode(ordered).alias("i", "m")).select(
        "question_id", "m.spot_name", (F.col("i") + 1).alias("mention_no")
    )
