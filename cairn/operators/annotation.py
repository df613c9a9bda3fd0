"""Work layers, rule labels, reading annotator and annotation tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.json_body import json_source
from cairn.functions.skew import key_sizes, salted_lookup_join
from cairn.functions.text import contains_any, strip, truncated, words_found
from cairn.operators.duplicates import representatives, with_representative
from cairn.operators.validation import is_usable, validate_annotations
from cairn.rules import DEFAULT_RULES, POLARITIES, Rules
from cairn.schema import RESPONSE_SCHEMA
from cairn.session import cut_lineage

RULE, REUSE, CALL, EXCLUDED = "rule", "reuse", "call", "excluded"


# --- work layers ------------------------------------------------------------------------------

def work_layers(reviews: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """M1: how each review gets its annotation.

    Precedence: empty text is excluded, a low-info text is labelled by rule, a duplicate that is
    not its group's representative reuses the representative's result, the rest is called.
    """
    # Told before the join: a plan that needs the layer and no text moves no text through it.
    empty = F.coalesce(strip(F.col("content")), F.lit("")) == ""
    grouped = with_representative(reviews.withColumn("_empty", empty), rules)
    member = F.col("representative_id").isNotNull() & (F.col("comment_id") != F.col("representative_id"))
    layer = (
        F.when(F.col("_empty"), EXCLUDED).when(F.col("is_low_info") == 1, RULE).when(member, REUSE).otherwise(CALL)
    )
    return grouped.withColumn("layer", layer).drop("_empty")


def pending_work(layered: DataFrame, sentiment: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Rows without a result yet; the result table itself is the cursor."""
    done = sentiment.filter(F.col("method") == rules.annotated_method).select("comment_id")
    return layered.filter(F.col("layer") != EXCLUDED).join(done, "comment_id", "left_anti")


def not_in(rows: DataFrame, excluded: DataFrame, key: str, other: str) -> DataFrame:
    """Rows whose key is in no row of the other table; a null there excludes nothing."""
    return rows.join(excluded.select(F.col(other).alias(key)).filter(F.col(key).isNotNull()).distinct(), key, "left_anti")


def layer_totals(layered: DataFrame, sentiment: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Per layer total, done and pending; pending must equal total minus done."""
    done = sentiment.filter(F.col("method") == rules.annotated_method).select(
        "comment_id", F.lit(1).alias("done")
    ).distinct()
    return (
        layered.join(done, "comment_id", "left").groupBy("layer")
        .agg(F.count(F.lit(1)).alias("total"), F.count("done").alias("done"))
        .withColumn("pending", F.col("total") - F.col("done"))
    )


# --- rule layer ----------------------------------------------------------------------------------

def rule_labels(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """M3: polarity from explicit sentiment words only; both or none means neutral."""
    staged = rows.withColumn("_t", strip(F.coalesce("content", F.lit(""))))
    text = F.col("_t")
    staged = staged.withColumns({
        "_pos": contains_any(text, rules.positive_words), "_neg": contains_any(text, rules.negative_words)})
    pos, neg = F.col("_pos"), F.col("_neg")
    found = F.slice(words_found(text, (*rules.positive_words, *rules.negative_words)), 1, rules.max_keywords)
    return staged.select(
        "comment_id", "spot_name",
        F.when(pos & ~neg, "positive").when(neg & ~pos, "negative").otherwise("neutral").alias("polarity"),
        F.when(pos != neg, 3).cast("int").alias("intensity"),
        F.lit(1).alias("is_valid"),
        F.nullif(F.array_join(found, ","), F.lit("")).alias("keywords"),
        F.nullif(F.substring(text, 1, rules.summary_chars), F.lit("")).alias("summary"),
    )


# --- reading annotator -----------------------------------------------------------------------------

def read_responses(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """M4: an annotator that reads the text by the word lists, in the shape of any other one.

    Polarity as in ``rule_labels``; an aspect is reported with the first of its words that occurs,
    which is its evidence; token counts follow the lengths of text and answer.
    """
    # Staged columns: the text and its hits are used many times and computed once.
    staged = rows.select("comment_id", "spot_name", "content", strip(F.coalesce("content", F.lit(""))).alias("_t"))
    text = F.col("_t")
    staged = staged.withColumns({
        "_pos": contains_any(text, rules.positive_words), "_neg": contains_any(text, rules.negative_words),
        "_words": words_found(text, (*rules.positive_words, *rules.negative_words))})
    pos, neg = F.col("_pos"), F.col("_neg")
    staged = staged.withColumn("_polarity", F.when(pos & ~neg, "positive").when(neg & ~pos, "negative").otherwise("neutral"))
    hits = F.array_compact(F.array(*[
        F.when(contains_any(text, words), F.struct(
            F.lit(aspect).alias("aspect"), F.col("_polarity").alias("polarity"),
            F.element_at(words_found(text, words), 1).alias("evidence")))
        for aspect, words in rules.aspect_words]))
    body = F.to_json(F.struct(
        F.col("_polarity").alias("polarity"), F.when(pos != neg, 3).alias("intensity"),
        F.slice(hits, 1, rules.max_aspects).alias("aspects"),
        F.slice("_words", 1, rules.max_keywords).alias("keywords"),
        F.substring(text, 1, rules.summary_chars).alias("summary")))
    size, answer = F.length(text).cast("bigint"), F.length("raw_text")
    return staged.withColumn("raw_text", body).select(
        "comment_id", "spot_name", "content", "raw_text", F.lit(1).alias("attempt"),
        F.floor(size / 1.5).alias("prompt_tokens"), F.floor(answer / 1.5).alias("completion_tokens"),
        F.floor((size + answer) / 1.5).alias("total_tokens"),
        F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error_reason"),
    )


# --- annotator job -----------------------------------------------------------------------------------

Annotator = Callable[[pd.Series], list]


def _answers(annotate: Annotator, texts: pd.Series, calls: int, limit: int) -> tuple[list, list[int]]:
    """One answer or exception per text, and how many calls each text was part of.

    A call that raises, or answers with another number of items, is repeated on both halves of its texts,
    down to single texts; a single text is called until it has been part of ``limit`` calls at least.
    So a text that breaks a call loses its own row only, after about log2 of the batch more calls.
    """
    if not len(texts):
        return [], []
    try:
        found = list(annotate(texts))
        if len(found) != len(texts):
            raise ValueError(f"{len(found)} answers to {len(texts)} texts")
        return found, [calls] * len(texts)
    except Exception as error:
        if len(texts) == 1:
            return ([error], [calls]) if calls >= limit else _answers(annotate, texts, calls + 1, limit)
    half = len(texts) // 2
    first, second = (_answers(annotate, part, calls + 1, limit) for part in (texts.iloc[:half], texts.iloc[half:]))
    return first[0] + second[0], first[1] + second[1]


def run_annotator(rows: DataFrame, annotate: Annotator, partitions: int | None = None, batch_rows: int | None = None,
                  attempts: int = 1) -> DataFrame:
    """M5: call an annotator batch by batch; a failing text becomes a failure row, not a failed job.

    ``annotate`` maps a Series of texts to a list with one item per text: a dict with ``raw_text``
    and token counts, or an exception.  If it raises, the guilty texts are found by halving the batch, and
    ``attempt`` tells how many calls a text was part of, ``attempts`` at least for one that fails alone.
    ``partitions`` bounds how many calls run at once, ``batch_rows`` the texts of one call.
    """
    work = rows.select("comment_id", "spot_name", "content")
    if partitions:
        work = work.repartition(partitions, "comment_id")
    names = RESPONSE_SCHEMA.fieldNames()

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = batch_rows or max(1, len(batch))
            for at in range(0, len(batch), size):
                part = batch.iloc[at:at + size]
                answers, calls = _answers(annotate, part["content"], 1, attempts)
                answers = [{"error_kind": type(a).__name__, "error_reason": str(a)} if isinstance(a, Exception) else a for a in answers]
                given = {"attempt": calls, **{n: part[n].tolist() for n in part.columns}}
                # Plain object columns: a missing count stays NULL instead of becoming NaN.
                yield pd.DataFrame({n: pd.Series([a.get(n, k) for a, k in zip(answers, given.get(n, [None] * len(answers)))], dtype=object)
                                    for n in names})

    return work.mapInPandas(job, RESPONSE_SCHEMA)


def failure_rows(responses: DataFrame) -> DataFrame:
    """One unresolved log row per failed text."""
    return responses.filter(F.col("error_kind").isNotNull()).select(
        F.lit("ERROR").alias("level"), F.lit("semantic").alias("stage"),
        F.concat(F.lit("["), "error_kind", F.lit("] "), F.coalesce("error_reason", F.lit(""))).alias("message"),
        F.col("comment_id").cast("string").alias("ref_key"), F.lit(0).alias("resolved"),
    )


def merge_calls(responses: DataFrame) -> DataFrame:
    """One row per text: the last attempt's answer, tokens and attempts of all calls added."""
    attempts = F.sum("attempts") if "attempts" in responses.columns else F.count(F.lit(1))
    return responses.groupBy("comment_id").agg(
        F.max_by("raw_text", "attempt").alias("raw_text"),
        F.count(F.lit(1)).alias("calls"), attempts.alias("attempts"),
        *[F.sum(t).alias(t) for t in ("prompt_tokens", "completion_tokens", "total_tokens")],
    )


def call_statistics(calls: DataFrame) -> DataFrame:
    """Requests, retries, tokens and failures by kind."""
    return calls.groupBy(F.coalesce("error_kind", F.lit("ok")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("attempts").alias("attempts"),
        (F.sum("attempts") - F.count(F.lit(1))).alias("retries"),
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
    )


# --- result tables -------------------------------------------------------------------------------

def annotated_rows(responses: DataFrame, mode: str = "real", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Validated results of the call layer with provenance.

    Responses carry the entity and text they answer; join stored ones with their reviews first.
    """
    answered = responses.filter(F.col("error_kind").isNull() & is_usable(F.col("raw_text"))).select(
        "comment_id", "spot_name", "content", "raw_text", "prompt_tokens", "completion_tokens", "total_tokens"
    )
    checked = validate_annotations(answered, rules)
    raw = F.to_json(F.struct(
        F.lit(rules.annotated_method).alias("source"), F.lit(mode).alias("mode"),
        "polarity", "intensity", "is_valid",
        F.transform("aspects", lambda a: a["aspect"]).alias("aspects"), "keywords", "summary",
        "dropped_aspects", "validation_reason",
        F.struct("prompt_tokens", "completion_tokens", "total_tokens").alias("usage"),
        F.col("raw_text").alias("model_raw"),
    ))
    return checked.select(
        "comment_id", "spot_name", "polarity", "intensity", "is_valid", "aspects", "keywords", "summary",
        F.lit(rules.annotated_method).alias("source"), raw.alias("raw_json"),
    )


def rule_rows(rows: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Results of the rule layer in the shape of ``annotated_rows``."""
    labelled = rule_labels(rows, rules)
    raw = F.to_json(F.struct(F.lit("rule").alias("source"), "polarity", "intensity", "is_valid", "keywords", "summary"))
    no_aspects = F.array().cast("array<struct<aspect:string,polarity:string,evidence:string>>")
    return labelled.select(
        "comment_id", "spot_name", "polarity", "intensity", "is_valid", no_aspects.alias("aspects"),
        "keywords", "summary", F.lit("rule").alias("source"), raw.alias("raw_json"),
    )


def sentiment_table(results: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """M10."""
    return results.select("comment_id", "spot_name", F.lit(rules.annotated_method).alias("method"),
                          "polarity", "intensity", "is_valid", "raw_json")


def aspect_table(results: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """One row per accepted aspect.

    The outer variant keeps the optimizer from testing the size of the (expensive) list twice.
    """
    exploded = results.select("comment_id", "spot_name", F.explode_outer("aspects").alias("a"))
    return exploded.filter(F.col("a").isNotNull()).select(
        "comment_id", "spot_name", F.col("a.aspect").alias("aspect_name"), "a.polarity", "a.evidence",
        F.lit(rules.annotated_method).alias("method"),
    )


def semantic_table(results: DataFrame) -> DataFrame:
    """M10."""
    return results.select("comment_id", "spot_name", "keywords", "summary", "source")


def reuse_rows(layered: DataFrame, results: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Members get their representative's result but keep their own entity.

    The lookup has one row per group; the members of a very large group are salted over tasks.
    A representative without a result leaves its members pending.
    """
    members = layered.filter(F.col("layer") == REUSE).select("comment_id", "spot_name", "representative_id")
    stands_for = layered.filter(F.col("comment_id") == F.col("representative_id")).select("representative_id")
    source = results.select(
        F.col("comment_id").alias("representative_id"), "polarity", "intensity", "is_valid",
        "aspects", "keywords", "summary", "source",
    ).join(stands_for, "representative_id", "left_semi")
    joined = salted_lookup_join(
        members, source, key_sizes(members, ["representative_id"]), ["representative_id"], "comment_id",
        rules.hot_key_rows, "inner")
    raw = F.to_json(F.struct(
        F.lit("reuse").alias("source"), F.lit("reuse").alias("mode"),
        F.col("representative_id").alias("reused_from_comment_id"),
        F.struct(*[F.lit(0).alias(t) for t in ("prompt_tokens", "completion_tokens", "total_tokens")]).alias("usage"),
    ))
    return joined.select(
        "comment_id", "spot_name", "polarity", "intensity", "is_valid", "aspects", "keywords", "summary",
        "source", raw.alias("raw_json"),
    )


def annotate_all(layered: DataFrame, responses: DataFrame, mode: str = "real", rules: Rules = DEFAULT_RULES) -> DataFrame:
    """All three layers together: rule, called and reused results.

    The called results are read twice, by the union and by the reuse lookup, so they are stored
    once.  Representatives are never low-info unless their whole group is, hence reuse only looks
    at called results.
    """
    ruled = rule_rows(layered.filter(F.col("layer") == RULE), rules)
    called = cut_lineage(annotated_rows(responses, mode, rules))
    return ruled.unionByName(called).unionByName(reuse_rows(layered, called, rules))


def layer_of_result(sentiment: DataFrame) -> Column:
    """Provenance of a stored result."""
    return json_source(sentiment["raw_json"])


def duplicate_representatives_pending(pending: DataFrame) -> DataFrame:
    """How many pending calls stand for a whole duplicate group."""
    reps = representatives(pending).select(F.col("representative_id").alias("comment_id"))
    return pending.join(reps, "comment_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
