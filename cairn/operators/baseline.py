"""Star-trained sentiment baseline: multinomial naive Bayes as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.features import term_rows, term_weights
from cairn.operators.statistics import polarity_name, weak_label
from cairn.rules import DEFAULT_RULES, Rules
from cairn.session import cut_lineage

LABELS = (0.0, 1.0, 2.0)
METRICS = ("accuracy", "f1", "weightedPrecision", "weightedRecall")


def in_training(key: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """About 80/20 by a digest of seed and id: the same split on any cluster layout."""
    digest = F.md5(F.concat_ws(":", F.lit(str(rules.seed)), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < 80


def labelled(features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Scored rows with their weak label and part: (comment_id, label, training)."""
    return features.filter(F.col("score").isNotNull()).select(
        "comment_id", weak_label(F.col("score")).alias("label"), in_training(F.col("comment_id"), rules).alias("training"))


def _by_label(value, name: str) -> list[Column]:
    return [value(label).alias(f"{name}{i}") for i, label in enumerate(LABELS)]


def train(features: DataFrame, rules: Rules = DEFAULT_RULES, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The model as two tables: a row per term (term, idf, s0..s2) and one row (vocabulary, t0..t2, d0..d2).

    ``s`` is a term's TF-IDF weight in each class, ``t`` the sum over all terms, ``d`` the training rows.
    ``terms`` are the term rows of ``features``, if they are already at hand.
    """
    terms = term_rows(features) if terms is None else terms
    weights = term_weights(terms, features, rules)
    chosen = labelled(features, rules).filter("training")
    # Counts are added up by term before they meet the weights: idf is the same in all rows of a term.
    sums = terms.join(chosen, "comment_id").groupBy("term").agg(*_by_label(
        lambda x: F.sum(F.when(F.col("label") == x, F.col("n"))), "n"))
    table = cut_lineage(weights.join(sums, "term", "left").select(
        "term", "idf", *[(F.coalesce(f"n{i}", F.lit(0)) * F.col("idf")).alias(f"s{i}") for i in range(len(LABELS))]))
    totals = table.agg(F.count(F.lit(1)).alias("vocabulary"), *[
        F.coalesce(F.sum(f"s{i}"), F.lit(0.0)).alias(f"t{i}") for i in range(len(LABELS))])
    docs = chosen.agg(*_by_label(lambda x: F.count_if(F.col("label") == x), "d"))
    return table, totals.join(F.broadcast(docs))


def predict(features: DataFrame, table: DataFrame, classes: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(comment_id, prediction) of every row by a model of ``train``, fresh or stored.

    A document's score is a sum over its terms.  Classes without a training row are never predicted;
    equal scores go to the smaller label.  Nothing but the one row of class totals is broadcast.
    """
    size = len(LABELS)
    classes = F.broadcast(classes)
    terms = term_rows(features) if terms is None else terms
    parts = terms.join(table, "term").join(classes).groupBy("comment_id").agg(*[
        F.sum(F.col("n") * F.col("idf") * (F.log(F.col(f"s{i}") + 1) - F.log(F.col(f"t{i}") + F.col("vocabulary")))).alias(f"p{i}")
        for i in range(size)])
    present = reduce(lambda a, b: a + b, [(F.col(f"d{i}") > 0).cast("int") for i in range(size)])
    all_docs = reduce(lambda a, b: a + b, [F.col(f"d{i}") for i in range(size)])
    score = [F.when(F.col(f"d{i}") > 0, F.coalesce(f"p{i}", F.lit(0.0)) + F.log(F.col(f"d{i}") + 1) - F.log(all_docs + present))
             for i in range(size)]
    best = F.greatest(*score)
    prediction = F.when(score[0] == best, LABELS[0]).when(score[1] == best, LABELS[1]).when(score[2] == best, LABELS[2])
    return features.select("comment_id").join(parts, "comment_id", "left").join(classes).select("comment_id", prediction.alias("prediction"))


def scored(features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """(comment_id, prediction) of every row by naive Bayes with smoothing 1 on TF-IDF.

    The features are read several times: store them first, by ``comment_id`` so that their terms are counted
    where they lie.  The term rows, many times their size, are not stored.
    """
    terms = term_rows(features)
    table, classes = train(features, rules, terms)
    return predict(features, table, cut_lineage(classes), terms)


def confusion(features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """Rows per (true label, prediction) of the test part."""
    test = labelled(features, rules).filter(~F.col("training"))
    return test.join(scored(features, rules), "comment_id").groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def evaluation(features: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The four metrics, all from the nine confusion counts, with seed and sizes."""
    counts = confusion(features, rules)
    cell = {(a, b): F.coalesce(F.sum(F.when((F.col("label") == a) & (F.col("prediction") == b), F.col("n"))), F.lit(0))
            for a in LABELS for b in LABELS}
    wide = counts.agg(*[c.alias(f"c{int(a)}{int(b)}") for (a, b), c in cell.items()])

    def total(cells: list[str]) -> Column:
        return reduce(lambda x, y: x + y, [F.col(c) for c in cells])

    everything = total([f"c{a}{b}" for a in range(3) for b in range(3)])
    recall = [F.coalesce(F.try_divide(F.col(f"c{i}{i}"), total([f"c{i}{b}" for b in range(3)])), F.lit(0.0)) for i in range(3)]
    precision = [F.coalesce(F.try_divide(F.col(f"c{i}{i}"), total([f"c{a}{i}" for a in range(3)])), F.lit(0.0)) for i in range(3)]
    f1 = [F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)) for p, r in zip(precision, recall)]
    share = [F.try_divide(total([f"c{i}{b}" for b in range(3)]), everything) for i in range(3)]

    def weighted(values: list[Column]) -> Column:
        return F.round(reduce(lambda x, y: x + y, [s * v for s, v in zip(share, values)]), 6)

    sizes = labelled(features, rules).agg(F.count_if("training").alias("train_rows"))
    row = wide.join(F.broadcast(sizes)).select(
        F.round(F.try_divide(total([f"c{i}{i}" for i in range(3)]), everything), 6).alias("accuracy"), weighted(f1).alias("f1"),
        weighted(precision).alias("weightedPrecision"), weighted(recall).alias("weightedRecall"), "train_rows",
        F.lit(rules.seed).alias("seed"), F.lit("score>=4 positive, 3 neutral, else negative").alias("label_rule"))
    return row.withColumn("metrics_json", F.to_json(F.struct(*row.columns)))


def predictions(features: DataFrame, rules: Rules = DEFAULT_RULES, scores: DataFrame | None = None) -> DataFrame:
    """Polarity of every modelling row, scored or not; ``scores`` come from ``predict``."""
    scores = scored(features, rules) if scores is None else scores
    return features.select("comment_id", "spot_name").join(scores, "comment_id").select(
        "comment_id", "spot_name", F.lit(rules.baseline_method).alias("method"),
        polarity_name(F.col("prediction")).alias("polarity"),
        F.lit(None).cast("int").alias("intensity"), F.lit(1).alias("is_valid"),
        F.to_json(F.struct(F.lit(rules.baseline_method).alias("source"), "prediction")).alias("raw_json"))


def mean_sentiment(polarity_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Optional filler for ``sentiment_avg``: positive 1, neutral 0.5, negative 0."""
    value = F.when(F.col("polarity") == "positive", 1.0).when(F.col("polarity") == "neutral", 0.5).otherwise(0.0)
    return polarity_rows.groupBy(*keys).agg(F.round(F.avg(value), 4).alias("sentiment_avg"))


def prediction_entities(predicted: DataFrame, review_entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions joined to (comment_id, spot_name), and the unmatched ones to count."""
    rows = predicted.drop("spot_name")
    return rows.join(review_entities, "comment_id"), rows.join(review_entities, "comment_id", "left_anti")
