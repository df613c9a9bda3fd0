"""Quality classifier as a sparse rule ensemble (operator 4).

Trees grown on text statistics give conjunctive rules, a lasso logistic regression weighs them, and
the rules that keep a weight become one Spark column expression over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.perplexity import CLASSES, base_counts
from cairn.llm.words import LOWER, NOT_BLANK, Sums, Words, map_texts, mix, quoted
from cairn.session import cut_lineage

STATISTICS = [
    "words", "word_length", "long_word", "symbols", "capitals", "digits", "punctuation", "non_ascii", "blanks",
    "dup_lines", "line_words", "repeated", "distinct", "commonest", "class_entropy", "marks_at_end",
]
#: At most so many labelled rows are used for fitting (a hash of the key chooses among more).
MAX_LABELLED = 40_000


def text_statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics of each text; all are 0 for a text without words."""
    n = len(offsets) - 1
    n_words, chars, _, dup_lines, repeated = base_counts(data, offsets)
    words = Words(data, offsets, NOT_BLANK)
    doc, length = words.documents(), words.end - words.start
    size = np.diff(offsets)
    per_word, per_byte = np.maximum(n_words, 1), np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / per_byte

    kinds = CLASSES[data]
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
    key = mix(Sums(LOWER[data]).of(words.start, words.end) + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, times = np.unique(key, return_index=True, return_counts=True)
    longest, commonest = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    np.maximum.at(commonest, doc[first], times)
    of_byte = np.repeat(np.arange(n), size)
    table = np.bincount(of_byte * 32 + kinds, minlength=n * 32).reshape(n, 32) / per_byte[:, None]
    entropy = -(table * np.log2(np.where(table > 0, table, 1))).sum(axis=1)
    last = np.bincount(doc, kinds[words.end - 1] == 3, n) if len(doc) else np.zeros(n)
    return {
        "words": np.log1p(n_words), "word_length": chars / per_word, "long_word": np.log1p(longest),
        "symbols": share(kinds == 3), "capitals": share(kinds == 5), "digits": share(kinds == 1),
        "punctuation": share(kinds == 2), "non_ascii": share(kinds == 4), "blanks": share(kinds == 0),
        "dup_lines": dup_lines / lines, "line_words": n_words / lines, "repeated": repeated / per_word,
        "distinct": np.bincount(doc[first], minlength=n) / per_word, "commonest": commonest / per_word,
        "class_entropy": entropy, "marks_at_end": last / per_word,
    }


def with_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    def compute(data, offsets, batch):
        found = text_statistics(data, offsets)
        return [pa.array(found[s].astype(np.float64)) for s in STATISTICS]

    return map_texts(docs, ", ".join(f"{s} double" for s in STATISTICS), compute, text, keep)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, threshold)."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [F.col(s) > t if above else F.col(s) <= t for s, above, t in self.parts])


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1 as one expression over the statistics."""
        total = reduce(lambda a, b: a + b, [F.when(r.column(), F.lit(w)).otherwise(F.lit(0.0)) for r, w in self.weights],
                       F.lit(float(self.intercept)))
        return 1 / (1 + F.exp(-total))


def tree_rules(model) -> list[Rule]:
    """Every path from a root to an inner node or leaf, with only the tightest bound of each kind."""
    found: dict[Rule, None] = {}

    def walk(node, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            found[Rule(tuple(sorted((s, above, t) for (s, above), t in bounds.items())))] = None
        if node.numDescendants() == 0:
            return
        split = node.split()
        name, t = STATISTICS[split.featureIndex()], float(split.threshold())
        walk(node.leftChild(), bounds | {(name, False): min(t, bounds.get((name, False), t))})
        walk(node.rightChild(), bounds | {(name, True): max(t, bounds.get((name, True), t))})

    for tree in model.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def fit(labelled: DataFrame, label: str, key: str, trees: int = 24, depth: int = 4, lasso: float = 5e-4,
        max_labelled: int = MAX_LABELLED, seed: int = 11) -> RuleModel:
    """Rules and weights from rows with the statistics and a 0/1 label.

    With one label only the model is that label's constant, without rows it is one half.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return RuleModel(0.0 if not counts else 4.0 if 1 in counts else -4.0, ())
    # A share of the hash range bounds the sample; the same rows are chosen in every run.
    chosen = F.pmod(F.xxhash64(F.col(quoted(key)), F.lit(seed)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.95 * max_labelled / total))
    rows = (labelled if total <= max_labelled else labelled.filter(chosen)).withColumn("__label", F.col(label).cast("double"))
    rows = cut_lineage(VectorAssembler(inputCols=STATISTICS, outputCol="__statistics").transform(rows.coalesce(4)))
    forest = RandomForestClassifier(featuresCol="__statistics", labelCol="__label", numTrees=trees, maxDepth=depth,
                                    maxBins=64, minInstancesPerNode=10, seed=seed).fit(rows)
    rules = tree_rules(forest)
    if not rules:
        share = counts[1] / total
        return RuleModel(float(np.log(share / (1 - share))), ())
    table = rows.select("__label", array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("__rules"))
    lasso_model = LogisticRegression(featuresCol="__rules", labelCol="__label", elasticNetParam=1.0, regParam=lasso,
                                     maxIter=60, standardization=False).fit(cut_lineage(table))
    weights = lasso_model.coefficients.toArray()
    return RuleModel(float(lasso_model.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6))


def held_out(key: str) -> Column:
    """Rows whose label is never learned from: crc32 of the key's text, modulo 5, is 0 (a null is "")."""
    return F.crc32(F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))) % 5 == 0


def score_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  threshold: float = 0.3, **options) -> DataFrame:
    """(key, held_out, score, predicted) of every document.

    Labels other than 0 and 1 and those without a key are not used; several labels of one key count
    by their majority.  Null, empty and blank texts have statistics of 0 and a score like any text;
    repeated rows score alike; an empty table gives an empty table.
    """
    rows = cut_lineage(with_statistics(docs.select(quoted(key), quoted(text)), text, [key]).withColumn("held_out", held_out(key)))
    truth = (labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
             .agg((F.avg(label) >= 0.5).cast("int").alias("__truth")))
    learn = rows.filter(~F.col("held_out")).join(truth, F.col(quoted(key)) == F.col("__key"))
    model = fit(learn, "__truth", key, **options)
    score = model.score()
    return rows.select(quoted(key), "held_out", score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
