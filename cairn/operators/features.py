"""Tokens and text features."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import strip
from cairn.rules import DEFAULT_RULES, Rules

_HAN = "\\p{IsHan}"


def tokens(text: Column) -> Column:
    """Lower-cased words; a run of Chinese characters becomes overlapping pairs.

    Punctuation never matches.  Swap in a segmenter through ``modelling_input(tokenizer=...)``.
    """
    pattern = f"([{_HAN}]+|[\\p{{L}}\\p{{N}}&&[^{_HAN}]]+)"
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), 1)

    def pairs(run: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
        return F.when(F.length(run) < 3, F.array(run)).otherwise(many)

    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{_HAN}]"), pairs(r)).otherwise(F.array(r))))


def modelling_rows(reviews: DataFrame) -> DataFrame:
    """texts that are present, not low-info and not duplicated."""
    return reviews.filter(
        (F.coalesce(strip(F.col("content")), F.lit("")) != "")
        & (F.col("is_low_info") == 0) & (F.col("is_dup_content") == 0)
    )


def modelling_input(reviews: DataFrame, stop_words: Sequence[str] = (),
                    tokenizer: Callable[[Column], Column] = tokens, token_column: str | None = None) -> DataFrame:
    """Tokens of two or more characters, rows without any dropped, stop words removed.

    ``token_column`` names tokens that are there already, e.g. those of ``segmentation.segment``.
    """
    given = F.col(token_column) if token_column else tokenizer(F.col("content"))
    words = F.filter(given, lambda t: F.length(t) >= 2)
    rows = modelling_rows(reviews).select("comment_id", "spot_name", "score", words.alias("tokens")).filter(
        F.size("tokens") > 0)
    if not stop_words:
        return rows.withColumn("filtered_tokens", F.col("tokens"))
    remover = StopWordsRemover(inputCol="tokens", outputCol="filtered_tokens", stopWords=list(stop_words))
    return remover.transform(rows)


def input_counters(reviews: DataFrame) -> DataFrame:
    """Input, low-info, duplicate and modelling rows in one aggregate."""
    usable = (
        (F.coalesce(strip(F.col("content")), F.lit("")) != "")
        & (F.col("is_low_info") == 0) & (F.col("is_dup_content") == 0))
    return reviews.agg(
        F.count(F.lit(1)).alias("input_rows"), F.count_if(F.col("is_low_info") == 1).alias("low_info_rows"),
        F.count_if(F.col("is_dup_content") == 1).alias("dup_rows"), F.count_if(usable).alias("modelling_rows"))


def token_report(features: DataFrame, stop_words: Sequence[str] = ()) -> DataFrame:
    """Token totals, mean per row and a stop-word leak check."""
    leaked = (F.size(F.array_intersect("filtered_tokens", F.array(*[F.lit(w) for w in stop_words])))
              if stop_words else F.lit(0))
    return features.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("filtered_tokens")).alias("token_count"),
        F.round(F.sum(F.size("filtered_tokens")) / F.count(F.lit(1)), 1).alias("mean_tokens"),
        F.sum(leaked).alias("leaked_stop_words"))


def top_terms(features: DataFrame, n: int = 20) -> DataFrame:
    """Most frequent terms, the order of the vocabulary."""
    return (
        features.select(F.explode("filtered_tokens").alias("term")).groupBy("term")
        .agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n))


def term_rows(features: DataFrame) -> DataFrame:
    """T4: (comment_id, term, n), the sparse counts; there is no vocabulary limit."""
    return features.select("comment_id", F.explode("filtered_tokens").alias("term")).groupBy("comment_id", "term").agg(
        F.count(F.lit(1)).alias("n"))


def term_weights(terms: DataFrame, features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """T5: (term, df, idf) of the terms in ``min_df`` documents or more; idf = ln((docs + 1) / (df + 1))."""
    docs = features.agg(F.count(F.lit(1)).alias("docs"))
    seen = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= rules.min_df)
    # The count is one row.
    return seen.join(F.broadcast(docs)).select("term", "df", F.log((F.col("docs") + 1) / (F.col("df") + 1)).alias("idf"))


def weighted_terms(features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """T4, T5: (comment_id, term, weight): counts times idf."""
    terms = term_rows(features)
    return terms.join(term_weights(terms, features, rules).select("term", "idf"), "term").select(
        "comment_id", "term", (F.col("n") * F.col("idf")).alias("weight"))


@dataclass(frozen=True)
class TextModel:
    """Count vectors for the topic models, whose vocabulary of ``min_df`` terms the driver holds whole."""

    counts: CountVectorizerModel

    def transform(self, features: DataFrame) -> DataFrame:
        return self.counts.transform(features)


def fit_text_model(features: DataFrame, rules: Rules = DEFAULT_RULES) -> TextModel:
    """Count vectors over all terms of ``min_df`` documents or more."""
    return TextModel(CountVectorizer(
        inputCol="filtered_tokens", outputCol="count_features", minDF=rules.min_df, minTF=1.0,
        vocabSize=2 ** 31 - 1).fit(features))
