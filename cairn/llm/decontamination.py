"""Benchmark decontamination by suffix arrays over the training texts (operator 1).

Each slice of a partition is one shard: its words are put in suffix order, and every suffix of the
benchmark is looked up by binary search.  The benchmark goes to the tasks in blocks of bounded size;
a larger benchmark means more blocks, each a further step of the same stage, so rows are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import ALNUM, LOWER, Sums, Words, given_names, map_texts, neutral_names, utf8

MATCHES = "matches"
_MATCH = ("array<struct<item_id:string,item_word:bigint,doc_word:bigint,n_words:bigint>>")


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words]:
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    return Sums(data).of(words.start, words.end), words


class SuffixArray:
    """Word suffixes of a shard, ordered by their first ``depth`` words; a document's end sorts first."""

    def __init__(self, hashes: np.ndarray, doc_end: np.ndarray, depth: int):
        n = len(hashes)
        self.hashes, self.doc_end = hashes, doc_end
        order = np.argsort(hashes)
        rank = np.zeros(n + 1, np.int64)
        starts = np.ones(n, bool)
        starts[1:] = hashes[order[1:]] != hashes[order[:-1]]
        rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0)) + 1
        self.first = hashes[order]
        done = 1
        while done < depth:
            alone = starts.copy()
            alone[:-1] &= starts[1:]
            at = np.flatnonzero(~alone)
            if not len(at):
                break
            suffix = order[at]
            follows = np.where(suffix + done < doc_end[suffix], suffix + done, n)
            key = rank[suffix] * (n + 2) + rank[follows]
            by = np.argsort(key)
            order[at], key = suffix[by], key[by]
            starts[at[1:]] |= key[1:] != key[:-1]
            rank[order[at]] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))[at] + 1
            done *= 2
        self.order = order

    def word(self, suffix: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        """The k-th word of each suffix, 0 after the document's end."""
        inside = suffix + k < self.doc_end[suffix]
        return np.where(inside, self.hashes[np.where(inside, suffix + k, 0)], np.uint64(0))

    def ranges(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``words`` the range of suffixes that begin with its first ``lengths`` words."""
        low = np.searchsorted(self.first, words[:, 0], side="left")
        high = np.searchsorted(self.first, words[:, 0], side="right")
        for k in range(1, words.shape[1]):
            deep = np.flatnonzero((lengths > k) & (low < high))
            if not len(deep):
                break
            target = words[deep, k]
            low[deep], high[deep] = (self._bound(low[deep], high[deep], k, target, right) for right in (False, True))
        return low, high

    def _bound(self, low: np.ndarray, high: np.ndarray, k: int, target: np.ndarray, right: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) // 2
            found = self.word(self.order[np.minimum(mid, len(self.order) - 1)], k)
            below = (found <= target) if right else (found < target)
            low, high = np.where(open_ & below, mid + 1, low), np.where(open_ & ~below, mid, high)
        return low


class TestBlock:
    """Distinct windows of a block of benchmark items, and the (item, first word) pairs of each."""

    __test__ = False

    def __init__(self, items: list[str], texts: list[str | None], window: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        hashes, words = hashed_words(data, offsets)
        self.items, self.window = items, window
        rows, lengths, item, first = [], [], [], []
        for i, (a, b) in enumerate(zip(words.offsets[:-1], words.offsets[1:])):
            for at in range(a, max(b - window, a) + 1) if b > a else ():
                rows.append(np.pad(hashes[at:min(b, at + window)], (0, max(0, window - (b - at)))))
                lengths.append(min(window, b - at))
                item.append(i)
                first.append(at - a)
        table = np.array(rows, np.uint64).reshape(-1, window)
        self.words, self.of = np.unique(table, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1)
        self.lengths = np.zeros(len(self.words), np.int64)
        self.lengths[self.of] = lengths
        by = np.argsort(self.of, kind="stable")
        self.item, self.first = np.array(item, np.int64)[by], np.array(first, np.int64)[by]
        self.starts = np.searchsorted(self.of[by], np.arange(len(self.words) + 1))

    def matches(self, hashes: np.ndarray, words: Words) -> tuple[np.ndarray, ...]:
        """Longest verbatim matches in a shard: document, item, first word in each, words."""
        none = np.zeros(0, np.int64)
        if not len(hashes) or not len(self.words):
            return none, none, none, none, none
        doc = words.documents()
        array = SuffixArray(hashes, words.offsets[1:][doc], self.window)
        low, high = array.ranges(self.words, self.lengths)
        found = high - low
        place = array.order[spread(low, found)]
        window = np.repeat(np.arange(len(found)), found)
        uses = (self.starts[1:] - self.starts[:-1])[window]
        use = spread(self.starts[:-1][window], uses)
        place, size = np.repeat(place, uses), self.lengths[np.repeat(window, uses)]
        item, first = self.item[use], self.first[use]
        # Neighbouring windows on one diagonal of (document, item) are one longer match.
        by = np.lexsort((place, place - first, item))
        place, item, first, size = place[by], item[by], first[by], size[by]
        begin = np.ones(len(place), bool)
        begin[1:] = ((np.diff(place) != 1) | (np.diff(item) != 0) | (np.diff(first) != 1)
                     | (doc[place[1:]] != doc[place[:-1]]))
        start = np.flatnonzero(begin)
        last = np.append(start[1:], len(place)) - 1 if len(start) else start
        return (doc[place[start]], item[start], first[start], place[start] - words.offsets[doc[place[start]]],
                place[last] - place[start] + size[last])


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] times, one after the other."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(before - start, count)


def test_blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> Iterator[TestBlock]:
    """The benchmark in blocks of about ``block_bytes`` of text; the driver holds one at a time."""
    items, texts, size = [], [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    for row in rows.filter("t IS NOT NULL").toLocalIterator():
        items.append(row.i)
        texts.append(row.t)
        size += len(row.t.encode())
        if size >= block_bytes:
            yield TestBlock(items, texts, window)
            items, texts, size = [], [], 0
    if items:
        yield TestBlock(items, texts, window)


test_blocks.__test__ = False


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", block_bytes: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """Documents with ``n_words``, ``n_hit``, ``longest`` and ``matches`` with the benchmark.

    Words are runs of digits, small letters (A-Z are lowered) and non-ASCII characters.  A match is
    the longest run of ``window`` or more words shared with an item at one place, or the whole item
    where it has fewer words; ``n_hit`` counts the document's words inside any match.

    Null and empty texts have no words and no matches, an item without words matches nothing, an
    item without id has the id "", and rows of the same item id are one item.  Repeated documents
    are matched each for itself; an empty table gives an empty table.  Columns with the names of
    the four added ones are replaced.
    """
    context = docs.sparkSession.sparkContext
    schema = f"n_words bigint, n_hit bigint, longest bigint, {MATCHES} {_MATCH}"
    match_type = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()),
                                     ("doc_word", pa.int64()), ("n_words", pa.int64())]))
    names = ["n_words", "n_hit", "longest", MATCHES]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in names]
    blocks = [context.broadcast(b) for b in test_blocks(benchmark, item_id, item_text, window, block_bytes)]
    out = docs
    for k, block in enumerate(blocks or [None]):
        def compute(data, offsets, batch, block=block, first=k == 0):
            hashes, words = hashed_words(data, offsets)
            if block is None:
                found = (np.zeros(0, np.int64),) * 5
                labels = np.zeros(0, object)
            else:
                found = block.value.matches(hashes, words)
                labels = np.array(block.value.items, object)[found[1]]
            doc, _, item_word, doc_word, size = found
            if not first:  # what earlier blocks have found
                old = batch.column(batch.schema.get_field_index(MATCHES))
                flat = old.flatten()
                of = np.repeat(np.arange(len(old)), old.value_lengths().to_numpy(zero_copy_only=False))
                parts = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
                doc, labels = np.append(of, doc), np.append(parts[0], labels)
                item_word, doc_word, size = (np.append(parts[i + 1], v) for i, v in enumerate((item_word, doc_word, size)))
            by = np.lexsort((item_word, labels.astype(str), doc_word, doc))
            doc, labels, item_word, doc_word, size = (v[by] for v in (doc, labels, item_word, doc_word, size))
            edges = np.zeros(len(hashes) + 1, np.int64)
            np.add.at(edges, words.offsets[doc] + doc_word, 1)
            np.add.at(edges, words.offsets[doc] + doc_word + size, -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edges)[:-1] > 0)])
            longest = np.zeros(len(words.counts), np.int64)
            np.maximum.at(longest, doc, size)
            records = pa.StructArray.from_arrays(
                [pa.array(labels, pa.string()), *(pa.array(v, pa.int64()) for v in (item_word, doc_word, size))],
                ["item_id", "item_word", "doc_word", "n_words"])
            where = np.searchsorted(doc, np.arange(len(words.counts) + 1)).astype(np.int32)
            return [pa.array(words.counts, pa.int64()), pa.array(np.diff(hit[words.offsets]), pa.int64()),
                    pa.array(longest, pa.int64()), pa.ListArray.from_arrays(pa.array(where), records).cast(match_type)]

        last = k >= len(blocks) - 1
        carried = kept if last else [*dict.fromkeys([*kept, text])]
        out = map_texts(out, schema, compute, text, carried, reads=[MATCHES] if k else [])
    return out.select(*kept, *names)



def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``find_matches`` reduced to the number of items and their sorted ids, and a verdict."""
    items = F.array_sort(F.array_distinct(F.col(f"{MATCHES}.item_id")))
    return (find_matches(docs, benchmark, **options).withColumn("items", items)
            .withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", F.col("n_hit") > 0))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents, with their columns, that share no window with the benchmark."""
    rows, names = neutral_names(docs)
    marked = find_matches(rows, benchmark, text=names[text], **options)
    return given_names(marked.filter("n_hit = 0"), names)
