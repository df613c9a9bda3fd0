"""Quality rules with character n-gram perplexity (operator 9).

Texts are read as characters (code points).  Spark counts their n-grams and fits a modified Kneser-Ney
model for every language by joins of the n-gram tables, one order after the other; a document whose
perplexity leaves its language's band is rejected.  No model is in one place: blocks of consecutive
rows ask for their different n-grams, and the answers meet the block's texts again.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.blocks import block_number, map_blocks
from cairn.llm.words import NOT_BLANK, Sums, Words, given_names, grams, mix, neutral_names, quoted, slices, utf8
from cairn.session import cut_lineage

ORDER, BITS = 4, 5
#: Bits of a code point; the three before the last one of an n-gram make one whole number.
SYMBOL_BITS = 21
#: So many languages are numbered and fitted at once; the next ones follow in further passes over their rows.
LANGUAGES_AT_ONCE = 16
#: Rows of a block, which asks once for each of its different n-grams.
BLOCK_ROWS_LOG2 = 12
#: Values below this are told apart by a table, others by sorting.
TABLE_SIZE = 1 << 24
MIN_WORDS = 50
#: Texts are scored in slices of about so many bytes; each byte takes some 100 bytes of memory.
SLICE_BYTES = 1 << 20
#: Bands are so many robust standard deviations wide on either side of the language's median.
LOWER_WIDTH, UPPER_WIDTH = 5.0, 6.0
#: Bands are read off a histogram of log10 perplexity with cells of this size.
CELL = 1e-4

_U = np.uint64


def _classes() -> np.ndarray:
    """Blank, digit, punctuation, symbol, first byte of a longer character, capital and the 26 small letters.

    The further bytes of a longer character tell the letters of a script apart: they share the
    classes of the small letters, which never follow a first byte themselves.
    """
    out = np.full(256, 3, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[48:58] = 1
    out[[ord(c) for c in ".,;:'\"?()-"]] = 2
    out[192:] = 4
    out[128:192] = 6 + np.arange(64) % 26
    out[65:91] = 5
    out[97:123] = np.arange(6, 32)
    return out


CLASSES = _classes()


def gram_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class n-grams of the slice and the document of each; the first three characters start none."""
    symbols = CLASSES[data].astype(np.int32)
    size = max(0, len(symbols) - ORDER + 1)
    ids = np.zeros(size, np.int32)
    for j in range(ORDER):
        ids = (ids << BITS) | symbols[j:j + size]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = doc[:size] == doc[ORDER - 1:ORDER - 1 + size]
    return ids[inside], doc[:size][inside]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice's UTF-8 bytes and the document of each."""
    start = np.flatnonzero((data & 0xC0) != 0x80)
    b = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    first, (x, y, z) = b[start], (b[start + j] & 63 for j in (1, 2, 3))
    points = np.select([first < 0x80, first < 0xE0, first < 0xF0], [first, (first & 31) << 6 | x, (first & 15) << 12 | x << 6 | y],
                       (first & 7) << 18 | x << 12 | y << 6 | z)
    return points, np.searchsorted(offsets, start, side="right") - 1


def _distinct(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The different values, which are below ``top``, and the place of each among them."""
    if top > TABLE_SIZE:
        return np.unique(values, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[values] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[values]


class CharGrams:
    """The different character n-grams of a slice by (model, context, last), and the place and document of each occurrence.

    ``context`` holds the three characters before the last one; the first three of a document start none.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, models: np.ndarray):
        points, doc = characters(data, offsets)
        n = max(0, len(points) - ORDER + 1)
        inside = np.flatnonzero(doc[:n] == doc[ORDER - 1:])
        self.doc = doc[:n][inside]
        alphabet, symbol = _distinct(points, 1 << SYMBOL_BITS)
        self.model, place = _distinct(models[self.doc], LANGUAGES_AT_ONCE)
        parts = [np.zeros(len(self.model), np.int64)]
        for j in range(ORDER):
            parts.append(alphabet[:0])
            width = max(1, len(alphabet))
            found, place = _distinct(place.astype(np.int64) * width + symbol[inside + j], len(parts[0]) * width)
            self.model = self.model[found // width]
            parts = [parts[0][found // width], alphabet[found % width]]
            if j < ORDER - 1:
                parts = [parts[0] << SYMBOL_BITS | parts[1]]
        self.context, self.last, self.place = parts[0], parts[1], place


_GRAMS = "block bigint, model int, context bigint, last int, n bigint"


def block_grams(rows: DataFrame, text: str) -> DataFrame:
    """(block, model, context, last, n): the different n-grams of every block and how often each occurs."""
    def ask(table: pa.Table) -> pa.Table:
        found = []
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, text, SLICE_BYTES):
                g = CharGrams(*utf8(part.column(part.schema.get_field_index(text))), _models(part))
                found.append(pa.table({"model": pa.array(g.model, pa.int32()), "context": pa.array(g.context, pa.int64()),
                                       "last": pa.array(g.last, pa.int32()), "n": np.bincount(g.place, minlength=len(g.last))}))
        sums = pa.concat_tables(found).group_by(["model", "context", "last"]).aggregate([("n", "sum")])
        return pa.table({"block": pa.repeat(table["block"][0], len(sums)), "model": sums["model"], "context": sums["context"],
                         "last": sums["last"], "n": sums["n_sum"]})

    return map_blocks(rows.select("block", "__model", text), ask, _GRAMS)


def _models(part: pa.RecordBatch) -> np.ndarray:
    return part.column(part.schema.get_field_index("__model")).to_numpy(zero_copy_only=False)


def fit_model(asked: DataFrame) -> DataFrame:
    """(model, context, last, log_prob): log10 probability of the last character after the context, by modified
    Kneser-Ney, for every n-gram that occurs.  The lower orders count the different characters before.

    Only the numbers of n-grams seen 1 to 4 times reach the driver, by language and order.
    """
    key = ["model", "context", "last"]
    tables = [cut_lineage(asked.groupBy(*key).agg(F.sum("n").alias("n")))]
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << SYMBOL_BITS * (order - 1)) - 1)).alias("context")
        tables.insert(0, tables[0].groupBy("model", shorter, "last").agg(F.count(F.lit(1)).alias("n")))
    seen = reduce(DataFrame.unionByName, [
        t.groupBy("model").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count(F.lit(1)).alias("all"))
        .withColumn("order", F.lit(order)) for order, t in enumerate(tables, start=1)]).collect()
    below = None
    for order, table in enumerate(tables, start=1):
        taken, least = F.lit(None).cast("double"), F.lit(None).cast("double")
        for r in (r for r in seen if r.order == order):
            _, *d = KneserNey.discounts_of(r.n1, r.n2, r.n3, r.n4).tolist()
            mine = F.col("model") == r.model
            taken = F.when(mine, F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])).otherwise(taken)
            least = F.when(mine, F.lit(1.0 / r.all)).otherwise(least)
        # No more rows than there are characters have one context.
        after = W.partitionBy("model", "context")
        staged = table.withColumn("taken", taken).withColumns({
            "total": F.sum("n").over(after), "gamma": F.sum("taken").over(after),
            "shorter": F.col("context").bitwiseAND(F.lit((1 << SYMBOL_BITS * max(0, order - 2)) - 1))})
        staged = staged.withColumn("below", least) if below is None else staged.join(
            below.select("model", F.col("context").alias("shorter"), "last", F.col("p").alias("below")), ["model", "shorter", "last"])
        below = staged.select(*key, ((F.col("n") - F.col("taken") + F.col("gamma") * F.col("below")) / F.col("total")).alias("p"))
    return below.select(*key, F.log10("p").alias("log_prob"))


def packed(rows: DataFrame, names: list[str]) -> DataFrame:
    """(block, rows): the columns ``names`` of every block as one compressed value."""
    def pack(table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (columns := table.select(names)).schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(columns)
        return pa.table({"block": table["block"].slice(0, 1), "rows": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return map_blocks(rows.select("block", *names), pack, "block bigint, rows binary")


class Answers:
    """log10 probabilities of a block's n-grams, found by (model, context, last)."""

    def __init__(self, table: pa.Table):
        context = table["context"].to_numpy()
        self.contexts = np.unique(context)
        key = self.key(table["model"].to_numpy(), context, table["last"].to_numpy())
        by = np.argsort(key)
        self.keys, self.values = key[by], table["log_prob"].to_numpy()[by]

    def key(self, model: np.ndarray, context: np.ndarray, last: np.ndarray) -> np.ndarray:
        of = np.searchsorted(self.contexts, context)
        return (model.astype(np.int64) * (len(self.contexts) + 1) + of) << SYMBOL_BITS | last

    def of(self, g: CharGrams) -> np.ndarray:
        if not len(g.last):
            return np.zeros(0)
        key = self.key(g.model, g.context, g.last)
        place = np.searchsorted(self.keys, key)
        if len(self.keys) <= place.max() or (self.keys[place] != key).any() or not np.isin(g.context, self.contexts).all():
            raise ValueError("the input was read in another order: store it first")
        return self.values[place]


@dataclass
class KneserNey:
    """The model of byte classes (32^4 n-grams at most) in one process, unseen n-grams included: sorted hashes of
    (model, order, n-gram) with log10 probability and log10 back-off weight."""

    keys: np.ndarray
    prob: np.ndarray
    backoff: np.ndarray

    @staticmethod
    def key(model: int, order: int, ids: np.ndarray) -> np.ndarray:
        return mix(ids.astype(np.uint64) + _U(model * 8 + order) * _U(1 << 40))

    @classmethod
    def fit(cls, counts: dict[int, tuple[np.ndarray, np.ndarray]]) -> KneserNey:
        keys, prob, backoff = [], [], []
        width = 1 << BITS
        for model, (ids, n) in sorted(counts.items()):
            table = np.zeros(width ** ORDER, np.float64)
            table[ids] = n
            tables = [table.reshape((width,) * ORDER)]
            while tables[0].ndim > 1:  # continuation counts: distinct symbols before
                tables.insert(0, (tables[0] > 0).sum(axis=0).astype(np.float64))
            lower = np.full((), 1.0 / width)
            for order, c in enumerate(tables, start=1):
                total = c.sum(axis=-1, keepdims=True)
                discount = cls.discounts(c)
                taken = discount[np.minimum(c, 3).astype(int)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gamma = np.where(total > 0, taken.sum(axis=-1, keepdims=True) / total, 1.0)
                    p = np.where(total > 0, (c - taken) / np.maximum(total, 1), 0.0) + gamma * lower
                seen = np.flatnonzero(c.reshape(-1) > 0)
                keys.append(cls.key(model, order, seen))
                prob.append(np.log10(p.reshape(-1)[seen]))
                # A context's weight stands with the context, an n-gram of the order below.
                backoff.append(np.zeros(len(seen)))
                weights = np.log10(np.maximum(gamma.reshape(-1), 1e-12))
                contexts = np.flatnonzero(total.reshape(-1) > 0)
                keys.append(cls.key(model, 8 - order, contexts) ^ _U(1))
                prob.append(np.zeros(len(contexts)))
                backoff.append(weights[contexts])
                lower = p
        if not keys:
            return cls(np.zeros(0, np.uint64), np.zeros(0, np.float32), np.zeros(0, np.float32))
        keys = np.concatenate(keys)
        by = np.argsort(keys)
        return cls(keys[by], np.concatenate(prob)[by].astype(np.float32), np.concatenate(backoff)[by].astype(np.float32))

    @classmethod
    def discounts(cls, c: np.ndarray) -> np.ndarray:
        return cls.discounts_of(*((c == k).sum() for k in (1, 2, 3, 4)))

    @staticmethod
    def discounts_of(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
        """Discounts for counts 0, 1, 2 and 3 or more, from the numbers of n-grams seen 1 to 4 times."""
        if min(n1, n2, n3, n4) == 0:
            return np.array([0, 0.5, 0.75, 0.9])
        y = n1 / (n1 + 2 * n2)
        return np.array([0] + [float(np.clip(k - (k + 1) * y * b / a, 0.05, k - 0.05))
                               for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        found = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        return place, found

    def log_prob(self, model: int, ids: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram after the others."""
        out = np.zeros(len(ids))
        open_ = np.arange(len(ids))
        for order in range(ORDER, 0, -1):
            left = ids[open_] & ((1 << (BITS * order)) - 1)
            place, found = self.find(self.key(model, order, left))
            out[open_[found]] += self.prob[place[found]]
            open_, left = open_[~found], left[~found]
            place, known = self.find(self.key(model, 8 - order, left >> BITS) ^ _U(1))
            out[open_[known]] += self.backoff[place[known]]
        out[open_] += np.log10(1.0 / (1 << BITS))
        return out


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Words, characters in words, symbols, repeated lines and words in repeated 3-word windows."""
    n = len(offsets) - 1
    words = Words(data, offsets, NOT_BLANK)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    doc = words.documents()
    chars = np.bincount(doc, points[words.end] - points[words.start], n).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))])
    sums = Sums(data)
    # Lines are cut at every newline and at the documents' ends.
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    starts, ends = cuts[:-1], cuts[1:]
    ends = np.where((ends > starts) & (data[np.maximum(ends - 1, 0)] == 10), ends - 1, ends) if len(ends) else ends
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[with_word], ends[with_word]
    line_doc = np.searchsorted(offsets, starts, side="right") - 1
    line_key = mix(sums.of(starts, ends) + line_doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    lines = np.bincount(line_doc, minlength=n)
    _, first = np.unique(line_key, return_index=True)
    dup_lines = lines - np.bincount(line_doc[first], minlength=n)
    # A word counts if one of the (up to) three windows that hold it occurs again in the document.
    windows = grams(sums.of(words.start, words.end), 3)
    inside = doc[:len(windows)] == doc[2:] if len(windows) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = mix(windows[at] + doc[at].astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, group, times = np.unique(key, return_inverse=True, return_counts=True)
    again = at[times[group] > 1]
    hit = np.zeros(len(doc), bool)
    for j in range(3):
        hit[again + j] = True
    return [words.counts.astype(np.int64), chars, np.diff(marks[offsets]), dup_lines.astype(np.int64),
            np.bincount(doc[hit], minlength=n).astype(np.int64)]


def languages(docs: DataFrame, lang: str) -> list[list[str | None]]:
    """The names of all languages, which are few, in groups that are handled at once; null comes first."""
    names = [r[0] for r in docs.select(quoted(lang)).distinct().orderBy(F.col(quoted(lang)).asc_nulls_first()).collect()]
    return [names[a:a + LANGUAGES_AT_ONCE] for a in range(0, len(names), LANGUAGES_AT_ONCE)] or [[]]


def bands(scored: DataFrame, lower: float, upper: float) -> dict[int, tuple[float, float]]:
    """Lower and upper log10 perplexity by model: the median and the median distance from it, over all
    documents of MIN_WORDS words or more, read off one histogram.
    """
    cells = scored.filter(f"n_words >= {MIN_WORDS} AND log_perplexity IS NOT NULL").groupBy(
        "model", F.floor(F.col("log_perplexity") / CELL).alias("cell")).count().toPandas()
    out = {}
    for model, part in cells.groupby("model"):
        value = (part["cell"].to_numpy() + 0.5) * CELL
        middle = _weighted_median(value, part["count"].to_numpy())
        spread = max(1.4826 * _weighted_median(np.abs(value - middle), part["count"].to_numpy()), 10 * CELL)
        out[int(model)] = middle - lower * spread, middle + upper * spread
    return out


def _weighted_median(value: np.ndarray, weight: np.ndarray) -> float:
    by = np.argsort(value)
    total = np.cumsum(weight[by])
    return float(value[by][np.searchsorted(total, total[-1] / 2)])


SCORES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity"]


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", lower: float = LOWER_WIDTH, upper: float = UPPER_WIDTH,
          keep: list[str] | None = None) -> DataFrame:
    """Documents with the counts of ``base_counts``, ``log_perplexity``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows.  The
    others are kept if their perplexity lies within their language's band, which follows from the
    documents of that language alone.  Null, empty and blank
    texts have no words and fail; a null language is a language; a text of fewer than 4 characters has no
    perplexity.  Repeated rows are judged alike; an empty table gives an empty table.  Columns with
    the names of the added ones are replaced.  The input must be a stored table, which is read alike again;
    rows that come in another order raise an error.
    """
    parts = [_judge_group(docs, names, text, lang, lower, upper, keep) for names in languages(docs, lang)]
    return reduce(DataFrame.unionByName, parts)


def _judge_group(docs: DataFrame, names: list[str | None], text: str, lang: str, lower: float, upper: float,
                 keep: list[str] | None) -> DataFrame:
    number = F.lit(None).cast("int")
    for k, name in enumerate(names):
        number = F.when(F.col(quoted(lang)).eqNullSafe(F.lit(name)), F.lit(k)).otherwise(number)
    kept = [c for c in (docs.columns if keep is None else keep) if c not in (*SCORES, "base_failed", "kept")]
    read = list(dict.fromkeys([*kept, text]))
    rows = docs.withColumn("__model", number).filter("__model IS NOT NULL").select("__model", *map(quoted, read)).withColumn(
        "block", block_number(BLOCK_ROWS_LOG2))
    asked = block_grams(rows, text)
    model = cut_lineage(fit_model(asked))
    answers = asked.drop("n").join(model, ["model", "context", "last"])

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        known, out = Answers(answers), []
        for batch in pa.ipc.open_stream(table["rows"][0].as_buffer()):
            for part in slices(batch, text, SLICE_BYTES):
                data, offsets = utf8(part.column(part.schema.get_field_index(text)))
                g, models = CharGrams(data, offsets, _models(part)), _models(part)
                size = np.bincount(g.doc, minlength=len(models))
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = -np.bincount(g.doc, known.of(g)[g.place], len(models)) / size
                added = [*(pa.array(c, pa.int64()) for c in base_counts(data, offsets)), pa.array(value, pa.float64(), mask=size == 0)]
                out.append(pa.Table.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), *added], [*names, *SCORES]))
        return pa.concat_tables(out)

    names = [*kept, "__model"]
    schema = T.StructType([rows.schema[c] for c in names] + list(T.StructType.fromDDL(
        ", ".join(f"{c} bigint" for c in SCORES[:-1]) + ", log_perplexity double")))
    packs = packed(rows, list(dict.fromkeys([*names, text])))
    scored = cut_lineage(packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema))
    limits = bands(scored.withColumnRenamed("__model", "model"), lower, upper)
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for m, (a, b) in limits.items():
        low, high = (F.when(F.col("__model") == m, F.lit(v)).otherwise(o) for v, o in ((a, low), (b, high)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.coalesce(F.col("log_perplexity").between(low, high), F.lit(False))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & inside).drop("__model")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", **options) -> DataFrame:
    """The documents, with their columns, that ``judge`` keeps."""
    rows, names = neutral_names(docs)
    judged = judge(rows, names[text], names[lang], **options)
    return given_names(judged.filter("kept"), names)
