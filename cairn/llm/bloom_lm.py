"""Language-model scores from a log-frequency Bloom filter (operator 3).

Documents are read in blocks of consecutive rows.  Each block sends its distinct words and pairs of
words, with their counts, to parts of the hash range; a part adds them up and builds its segment of the
filter: for a count c the keys (n-gram, 1) .. (n-gram, level of c).  Counts are read back by probing level
after level until one is missing.  The part answers each block's words and pairs with what its segment
says, and the words with their exact counts; so all segments together grow with the corpus, and nothing
but one part's segment is ever held in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import block_number, map_blocks, table_of
from cairn.llm.words import LOWER, NOT_BLANK, Sums, Words, mix, quoted, slices, utf8
from cairn.session import cut_lineage

BLOCK_ROWS_LOG2 = 12
ROWS_PER_PART = 8192
#: Levels of the counts grow by this factor.
BASE = 1.5
BITS_PER_ENTRY, PROBES = 8, 5
#: Pseudo-counts of the word distribution in the distribution after a word.
PRIOR = 20.0
WORDS, PAIRS = 0, 1

_U = np.uint64
_START, _END = _U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)
_KEYS = "kind int, part bigint, block bigint, keys binary, counts binary, more binary, more_counts binary, unlearned binary"
_FOUND = "kind int, part bigint, block bigint, counts binary, levels binary, distinct_n bigint, total_n bigint"


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes with one end for each document, the hash of each token before, and offsets."""
    data = LOWER[data]
    words = Words(data, offsets, NOT_BLANK)
    at = words.offsets + np.arange(len(offsets))
    tokens = np.full(int(at[-1]), _END, np.uint64)
    tokens[np.arange(len(words.start)) + words.documents()] = Sums(data).of(words.start, words.end)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[at[:-1]] = _START
    return tokens, before, at


def pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0xD6E8FEB86659FD93) + tokens)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (((keys >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log_BASE(count)); 0 for 0."""
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def decoded(level: np.ndarray) -> np.ndarray:
    """The count in the middle of a level; level 1 is a count of 1."""
    return np.where(level > 1, BASE ** (level - 0.5), np.where(level == 1, 1.0, 0.0))


def _places(low: np.ndarray, level: np.ndarray | int, bits: np.ndarray | int) -> list[np.ndarray]:
    h = mix((low & _U(0xFFFFFFFF)) * _U(0x9E3779B97F4A7C15) + _U(1) * np.asarray(level, np.uint64))
    step = (h >> _U(32)) | _U(1)
    return [((h + _U(i) * step) & _U(0x7FFFFFFFFFFFFFFF)) % np.asarray(bits, np.uint64) for i in range(PROBES)]


def build_segment(low: np.ndarray, counts: np.ndarray, most_bytes: int | None = None) -> tuple[bytes, int, int]:
    """Bits of one part, the number of entries, and the least count that is held.

    Without ``most_bytes`` all counts are held, at BITS_PER_ENTRY; with it the least counts go first if
    their entries do not fit.
    """
    level = levels(counts)
    by_count = np.bincount(level)
    # Entries if only levels of k or more are held: each n-gram has as many entries as its level.
    entries = np.cumsum((by_count * np.arange(len(by_count)))[::-1])[::-1]
    least = 1
    most_bytes = 1 << 62 if most_bytes is None else most_bytes
    while least < len(entries) and entries[least] * BITS_PER_ENTRY > most_bytes * 8:
        least += 1
    held = level >= least
    low, level, n = low[held], level[held], int(entries[least]) if least < len(entries) else 0
    size = max(8, min(most_bytes, -(-n * BITS_PER_ENTRY // 8)))
    bits = np.zeros(size * 8, np.uint8)
    for j in range(1, int(level.max(initial=0)) + 1):
        for place in _places(low[level >= j], j, size * 8):
            bits[place.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes(), n, int(np.ceil(BASE ** (least - 1)))


@dataclass
class LogFilter:
    """Segments of all parts one after the other."""

    bits: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, segments: dict[int, bytes], parts: int) -> LogFilter:
        size = np.array([8 * len(segments.get(p, b"")) for p in range(parts)], np.int64)
        bits = np.frombuffer(b"".join(segments.get(p, b"") for p in range(parts)), np.uint8)
        return cls(bits, np.cumsum(size) - size, size)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return decoded(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels read by probing: the last of 1, 2, ... that are all there."""
        level = np.zeros(len(keys), np.int64)
        part = part_of(keys, len(self.size)) if len(self.size) else np.zeros(len(keys), np.int64)
        open_ = np.flatnonzero(self.size[part] > 0) if len(self.size) else np.zeros(0, np.int64)
        for j in range(1, 200):
            if not len(open_):
                break
            size, first = self.size[part[open_]], self.first[part[open_]]
            there = np.ones(len(open_), bool)
            for place in _places(keys[open_], j, size):
                at = first + place.astype(np.int64)
                there &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
            open_ = open_[there]
            level[open_] = j
        return level


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    unique, place = np.unique(np.concatenate(keys), return_inverse=True)
    return unique, np.bincount(place, np.concatenate(counts), len(unique)).astype(np.int64)


def _as_batches(table: pa.Table, text: str):
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch, text, 2 << 20):
            yield part, *tokens_of(*utf8(part.column(part.schema.get_field_index(text))))


def _learned(part: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """Whether each token is one to learn from."""
    return np.repeat(~part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False), np.diff(at))


def _block_pairs(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of a block with their training counts, 0 for pairs of held-out rows only."""
    pairs = ([], [])
    for part, tokens, before, at in _as_batches(table, "text"):
        keys, place = np.unique(pair_keys(before, tokens), return_inverse=True)
        pairs[0].append(keys)
        pairs[1].append(np.bincount(place[_learned(part, at)], minlength=len(keys)))
    return _summed(*pairs)


def _list_of(counts: np.ndarray) -> np.ndarray:
    """The list that a pair is sent in: those of count 1, those of more, those of none."""
    return np.where(counts == 1, 0, np.where(counts > 1, 1, 2))


def _ask(parts: int):
    def ask(table: pa.Table) -> pa.Table:
        """Distinct words and pairs of a block with their training counts, by part."""
        words = ([], [])
        for part, tokens, _, at in _as_batches(table, "text"):
            keys, place = np.unique(tokens, return_inverse=True)
            words[0].append(keys)
            words[1].append(np.bincount(place[_learned(part, at)], minlength=len(keys)))
        block, rows = table["block"][0].as_py(), []
        for kind, (keys, counts) in ((WORDS, _summed(*words)), (PAIRS, _block_pairs(table))):
            of = part_of(keys, parts)
            edges = np.searchsorted(of, np.arange(parts + 1))
            for p in np.unique(of).tolist():
                k, c = keys[edges[p]:edges[p + 1]], counts[edges[p]:edges[p + 1]]
                if kind == WORDS:
                    rows.append((kind, p, block, k.tobytes(), c.astype(np.uint32).tobytes(), None, None, None))
                else:  # the part and 32 bits more name a pair; most pairs are there once
                    low, of_list = k.astype(np.uint32), _list_of(c)
                    single, more, unlearned = (low[of_list == j].tobytes() for j in range(3))
                    rows.append((kind, p, block, single, None, more, c[of_list == 1].astype(np.uint32).tobytes(), unlearned))
        return table_of(rows, _KEYS)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Sums of one part; for each block what the part's segment says, and words' exact counts, in the order they were asked."""
    kind, part = table["kind"][0].as_py(), table["part"][0].as_py()
    keys, counts, asked = [], [], []
    for row in table.select(["block", "keys", "counts", "more", "more_counts", "unlearned"]).to_pylist():
        if kind == WORDS:
            k, c = np.frombuffer(row["keys"], np.uint64), np.frombuffer(row["counts"], np.uint32)
        else:
            lists = [np.frombuffer(row[name], np.uint32) for name in ("keys", "more", "unlearned")]
            k = np.concatenate(lists)
            c = np.concatenate([np.ones(len(lists[0]), np.uint32), np.frombuffer(row["more_counts"], np.uint32),
                                np.zeros(len(lists[2]), np.uint32)])
        asked.append((row["block"], k))
        keys.append(k)
        counts.append(c)
    unique, total = _summed(keys, counts)
    seen = total > 0
    low = unique.astype(np.uint64)
    bits, _, _ = build_segment(low[seen], total[seen])
    level = LogFilter.of({0: bits}, 1).levels(low).astype(np.uint8)
    rows = [(kind, part, -1, None, None, int(seen.sum()), int(total.sum()))]
    for block, k in asked:
        at = np.searchsorted(unique, k)
        rows.append((kind, part, block, total[at].tobytes() if kind == WORDS else None, level[at].tobytes(), None, None))
    return table_of(rows, _FOUND)


def held_out(key: str) -> Column:
    """Rows that nothing is learned from: crc32 of the key's text, modulo 7, is 2 (a null is "")."""
    return F.crc32(F.coalesce(F.col(quoted(key)).cast("string"), F.lit(""))) % 7 == 2


_SCORES = "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", train: Column | None = None,
                    prior: float = PRIOR) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are the words between ASCII blanks, A-Z lowered, and one end; null and empty texts are
    the end alone.  ``base_score`` uses exact counts.  ``score`` is the log10 probability under
    (c(v w) + prior * P(w)) / (c(v) + prior) with P(w) = (c(w) + 1) / (N + V + 1) and counts read from
    the filters, which hold all n-grams of the corpus.  Rows are scored each for itself, so repeated or null keys do no harm; an empty table
    gives an empty table.  The input must be a stored table, which is read alike twice.
    """
    out_rows = held_out(key) if train is None else ~train
    rows = docs.select(F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"),
                       F.coalesce(out_rows, F.lit(True)).alias("held_out")).withColumn("block", block_number(BLOCK_ROWS_LOG2))
    parts = 8 + rows.count() // ROWS_PER_PART
    asked = map_blocks(rows, _ask(parts), _KEYS)
    found = cut_lineage(asked.groupBy("kind", "part").applyInArrow(_answer, _FOUND))
    sums = found.filter(f"block = -1 AND kind = {WORDS}").agg(F.sum("total_n").alias("n"), F.sum("distinct_n").alias("v")).first()
    n, v = sums["n"] or 0, sums["v"] or 0

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        by = np.lexsort((answers["part"].to_numpy(), answers["kind"].to_numpy()))
        kinds, counts, levels_of = answers["kind"].to_pylist(), answers["counts"].to_pylist(), answers["levels"].to_pylist()
        exact = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(counts[i], np.int64) for i in by if kinds[i] == WORDS])
        word_counts, told = (decoded(np.concatenate([np.zeros(0, np.uint8)] + [np.frombuffer(levels_of[i], np.uint8) for i in by if kinds[i] == k]))
                             for k in (WORDS, PAIRS))
        known_pairs, pair_n = _block_pairs(mine)
        pair_counts = np.empty(len(known_pairs))
        pair_counts[np.lexsort((_list_of(pair_n), part_of(known_pairs, parts)))] = told
        known = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [np.unique(t) for _, t, _, _ in _as_batches(mine, "text")]))
        base = np.log10((exact + 1) / (n + v + 1))
        chance = (word_counts + 1) / (n + v + 1)
        columns = [[] for _ in range(4)]
        for part, tokens, before, at in _as_batches(mine, "text"):
            word = np.searchsorted(known, tokens)
            last = np.minimum(np.searchsorted(known, before), len(known) - 1)
            pair = pair_counts[np.searchsorted(known_pairs, pair_keys(before, tokens))]
            # The start comes before as many first words as there are ends.
            end = word_counts[np.searchsorted(known, _END)]
            context_count = np.where(before == _START, end, word_counts[last])
            p = (np.minimum(pair, context_count) + prior * chance[word]) / (context_count + prior)
            sums = [np.ones(len(tokens)), exact[word] > 0, base[word], np.log10(p)]
            for out, values in zip(columns, sums):
                out.append(np.add.reduceat(values.astype(np.float64), at[:-1]))
        n_tokens, n_known, base_score, model = (np.concatenate(c) for c in columns)
        return pa.table({
            "key": mine["key"], "held_out": mine["held_out"], "n_tokens": n_tokens.astype(np.int64),
            "n_known": n_known.astype(np.int64), "train_tokens": np.full(len(n_tokens), n), "base_score": base_score, "score": model})

    answers = found.filter("block >= 0").select("kind", "block", "part", "counts", "levels")
    schema = f"key {docs.schema[key].dataType.simpleString()}, held_out boolean, {_SCORES}"
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return scored.withColumnRenamed("key", key)
