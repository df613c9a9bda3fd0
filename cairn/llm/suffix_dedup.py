"""Removal of repeated byte strings by suffix arrays with previous and next smaller positions (operator 8).

A string of 50 bytes is removed where it also starts in an earlier document.  Documents are read in
blocks of consecutive rows, in three steps:

1. Anchors, the least hash of the 20-byte grams in every 50-byte window, are the same wherever a
   window is repeated.  Each block sends its anchors, with a hash of their surroundings (all windows
   that hold the anchor) and their first document, to parts of the hash range.
2. Surroundings that occur elsewhere are sent to shards, once for each block.  A shard puts all
   their suffixes in order; the previous and the next suffix of a smaller document in that order are
   the best earlier matches (the longest previous factor), and a match of 50 bytes covers its window.
3. The blocks take the answers and remove the covered bytes.

Anchors with very many surroundings (a licence line in a third of all documents) are not compared as
surroundings: their windows are sent one by one, each to the shard of its own hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.blocks import block_number, map_blocks, table_of
from cairn.llm.decontamination import spread
from cairn.llm.words import Sums, mix, quoted, slices, utf8
from cairn.session import cut_lineage

LENGTH, GRAM = 50, 20
BLOCK_ROWS_LOG2 = 10
#: Anchors are looked for in slices of about so many bytes; each byte takes some 100 bytes of memory.
SLICE_BYTES = 1 << 18
#: A part gets the anchors of about so many documents, some 100 bytes of memory for each anchor.
ROWS_PER_PART = 1024
#: A shard gets about so many bytes of strings, at most; each byte takes some 80 bytes of memory.
SHARD_BYTES = 1 << 19
#: The windows of so many entries are cut at once.
ENTRIES_AT_ONCE = 512
#: An anchor with more different surroundings has its windows dealt one by one.
MANY_SURROUNDINGS = 4096
NO_KEY = np.iinfo(np.int64).max

_U = np.uint64
_NONE, _COVERED, _COMPARE, _WINDOWS = 0, 1, 2, 3
_ASKED = "part bigint, block bigint, low binary, around binary, around_high binary, first binary, width int, base bigint"
_CODES = "kind int, part bigint, block bigint, answer binary, coming bigint"
_STRINGS = "kind int, part bigint, block bigint, keys binary, lengths binary, bytes binary"


def _slide(values: np.ndarray, n: int, better) -> np.ndarray:
    """The best of the n values from each place on; the last n - 1 places see fewer."""
    out, width = values.copy(), 1
    while 2 * width <= n:
        out[:-width or None] = better(out[:-width or None], out[width:]) if len(out) > width else out
        width *= 2
    rest = n - width
    if rest and len(out) > rest:
        out[:-rest] = better(out[:-rest], out[rest:])
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Hash and surroundings' hash, start and end of every anchor of a slice, and its document."""
    n, size = len(data), np.diff(offsets)
    if n < length:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    sums = Sums(data)
    left = np.repeat(offsets[1:], size) - np.arange(n)
    hashes = sums.of_all(gram)
    # The order of grams takes the upper half of the hash; equal halves are both anchors.
    top = np.uint32(0xFFFFFFFF)
    upper = np.full(n, top)
    upper[:len(hashes)] = np.minimum(hashes >> _U(32), _U(0xFFFFFFFE))
    upper[left < gram] = top
    windows = length - gram + 1
    least = _slide(upper, windows, np.minimum)
    least[left < length] = 0
    back = _slide(np.concatenate([np.zeros(windows - 1, np.uint32), least]), windows, np.maximum)[:n]
    place = np.flatnonzero((back == upper) & (upper != top))
    doc = np.searchsorted(offsets, place, side="right") - 1
    start, stop = np.maximum(place - (length - gram), offsets[doc]), np.minimum(place + length, offsets[doc + 1])
    around = mix(sums.of(start, stop) + (place - start).astype(np.uint64))
    return hashes[place], around, start, stop, doc


def shard_edges(names: np.ndarray, parts: int, shards: int) -> np.ndarray:
    """Edges of the shards among entries in order of their names, which spread evenly below parts x 2^32."""
    shard = ((names // _U(parts)) * _U(shards)) >> _U(32)
    return np.searchsorted(shard, np.arange(shards + 1).astype(np.uint64))


class Block:
    """The anchors of a block: occurrences, and distinct (anchor, surroundings) entries by part."""

    def __init__(self, table: pa.Table, parts: int, length: int, gram: int, shards: int = 1):
        self.length, self.parts, self.shards = length, parts, shards
        self.data, self.offsets = utf8(table["text"])
        self.key = table["key"].fill_null(NO_KEY).to_numpy().astype(np.int64)
        found, at, row = [], 0, 0
        for batch in table.combine_chunks().to_batches():
            for part in slices(batch, "text", SLICE_BYTES):
                data, offsets = utf8(part.column(part.schema.get_field_index("text")))
                h, around, start, stop, doc = anchors(data, offsets, length, gram)
                found.append((h, around, start + at, stop + at, doc + row))
                at, row = at + len(data), row + part.num_rows
        empty = (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
        h, around, self.start, self.stop, self.doc = (np.concatenate(c) for c in zip(empty, *found))
        part = ((h >> _U(32)) * _U(parts)) >> _U(32)
        name, around = (part << _U(32)) | (h & _U(0xFFFFFFFF)), around >> _U(16)
        order = np.lexsort((self.key[self.doc], around, name))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(name[order]) != 0) | (np.diff(around[order]) != 0)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.holder = order[new]  # an occurrence in the entry's first document
        self.name, self.around, self.first = name[self.holder], around[self.holder], self.key[self.doc[self.holder]]
        self.edges = np.searchsorted(self.name >> _U(32), np.arange(parts + 1).astype(np.uint64))

    def questions(self, block: int) -> pa.Table:
        base = int(self.first.min()) if len(self.first) else 0
        # Keys go as offsets in the fewest bytes that hold the block's range.
        apart = (self.first - base).view(np.uint64)
        width = next(w for w in (2, 4, 8) if not len(apart) or int(apart.max()) < 1 << (8 * w))
        rows = []
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            s = slice(self.edges[p], self.edges[p + 1])
            around = self.around[s]
            rows.append((p, block, self.name[s].astype(np.uint32).tobytes(), around.astype(np.uint32).tobytes(),
                         (around >> _U(32)).astype(np.uint16).tobytes(), apart[s].astype(f"u{width}").tobytes(), width, base))
        return table_of(rows, _ASKED)

    def codes(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        out = np.zeros(len(self.name), np.uint8)
        for p in np.flatnonzero(np.diff(self.edges)).tolist():
            out[self.edges[p]:self.edges[p + 1]] = np.frombuffer(answers[_NONE, p], np.uint8)
        return out

    def compared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries whose surroundings go to a shard, and the edges of the shards among them."""
        entries = np.flatnonzero(codes == _COMPARE)
        return entries, shard_edges(self.name[entries], self.parts, self.shards)

    def window_edges(self, h: np.ndarray) -> np.ndarray:
        return np.searchsorted(((h >> _U(32)) * _U(self.shards)) >> _U(32), np.arange(self.shards + 1).astype(np.uint64))

    def windows(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Windows of the many-surroundings entries: start and entry of each, its string, and for each
        distinct string its hash, a start and the first key."""
        entries = np.flatnonzero(codes == _WINDOWS)
        start, stop = self.start[self.holder[entries]], self.stop[self.holder[entries]]
        count = stop - start - self.length + 1
        at, of = spread(start, count), np.repeat(entries, count)
        # Sums are taken of the cut strings, a bounded number at once.
        h, step = np.zeros(len(at), np.uint64), ENTRIES_AT_ONCE * (self.length // 2)
        for a in range(0, len(at), step):
            some = at[a:a + step]
            edge = np.arange(len(some) + 1) * self.length
            h[a:a + step] = Sums(self.data[spread(some, np.full(len(some), self.length))]).of(edge[:-1], edge[1:])
        order = np.lexsort((self.first[of], h))
        new = np.ones(len(order), bool)
        new[1:] = np.diff(h[order]) != 0
        string = np.empty(len(order), np.int64)
        string[order] = np.cumsum(new) - 1
        one = order[new]
        return at, of, string, h[one], at[one], self.first[of[one]]

    def strings(self, block: int, codes: np.ndarray) -> pa.Table:
        rows = []
        entries, edges = self.compared(codes)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            e = entries[edges[p]:edges[p + 1]]
            start, size = self.start[self.holder[e]], (self.stop - self.start)[self.holder[e]]
            rows.append((_COMPARE, p, block, self.first[e].tobytes(), size.astype(np.uint8).tobytes(), self.data[spread(start, size)].tobytes()))
        _, _, _, h, start, first = self.windows(codes)
        edges = self.window_edges(h)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            s = slice(edges[p], edges[p + 1])
            size = np.full(edges[p + 1] - edges[p], self.length)
            rows.append((_WINDOWS, p, block, first[s].tobytes(), size.astype(np.uint8).tobytes(), self.data[spread(start[s], size)].tobytes()))
        return table_of(rows, _STRINGS)

    def covered(self, answers: dict[tuple[int, int], bytes]) -> np.ndarray:
        """Which bytes of the block are covered by a string of an earlier document."""
        codes = self.codes(answers)
        edge = np.zeros(len(self.data) + 1, np.int64)

        def mark(start: np.ndarray, stop: np.ndarray) -> None:
            np.add.at(edge, start, 1)
            np.add.at(edge, stop, -1)

        # The whole surroundings stand in an earlier document, of this block or of another.
        whole = (self.key[self.doc] > self.first[self.entry]) | (codes[self.entry] == _COVERED)
        mark(self.start[whole], self.stop[whole])
        own = np.flatnonzero(~whole)
        mask = np.zeros(len(codes), np.uint32)
        entries, edges = self.compared(codes)
        for p in np.flatnonzero(np.diff(edges)).tolist():
            mask[entries[edges[p]:edges[p + 1]]] = np.frombuffer(answers[_COMPARE, p], np.uint32)
        at, of, string, h, _, first = self.windows(codes)
        if len(at):
            edges = self.window_edges(h)
            hit = np.zeros(len(h), bool)
            for p in np.flatnonzero(np.diff(edges)).tolist():
                hit[edges[p]:edges[p + 1]] = np.frombuffer(answers[_WINDOWS, p], np.uint32) > 0
            # The string stands in an earlier document of another block, or of this one.
            there = np.flatnonzero(hit[string] | (first[string] < self.first[of]))
            np.bitwise_or.at(mask, of[there], (_U(1) << (at[there] - self.start[self.holder[of[there]]]).astype(np.uint64)).astype(np.uint32))
        for i in range(32):
            with_bit = own[(mask[self.entry[own]] >> np.uint32(i)) & np.uint32(1) > 0]
            mark(self.start[with_bit] + i, self.start[with_bit] + i + self.length)
        return np.cumsum(edge[:-1]) > 0


def _answer_anchors(many: int, length: int, gram: int):
    most = 2 * length - gram  # bytes of the surroundings

    def answer(table: pa.Table) -> pa.Table:
        """For each entry of one part: alone, covered by an earlier document, or to be compared; and
        a bound of the bytes that its block will send to shards."""
        rows = table.to_pylist()
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
        around = np.concatenate([np.frombuffer(r["around"], np.uint32).astype(np.uint64)
                                 | np.frombuffer(r["around_high"], np.uint16).astype(np.uint64) << _U(32) for r in rows])
        first = np.concatenate([np.frombuffer(r["first"], f"u{r['width']}").astype(np.uint64).view(np.int64) + r["base"] for r in rows])
        order = np.lexsort((first, around, low))
        new_low = np.ones(len(order), bool)
        new_low[1:] = np.diff(low[order]) != 0
        new = new_low.copy()
        new[1:] |= np.diff(around[order]) != 0
        least = first[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        of_low = np.cumsum(new_low) - 1
        different = np.bincount(of_low, new)[of_low] if len(order) else np.zeros(0)
        code = np.where(first[order] > least, _COVERED,
                        np.where(different > many, _WINDOWS, np.where(different > 1, _COMPARE, _NONE)))
        out = np.empty(len(order), np.uint8)
        out[order] = code
        edges = np.cumsum([0] + [len(r["low"]) // 4 for r in rows])
        sent = np.where(out == _COMPARE, most, np.where(out == _WINDOWS, (length - gram + 1) * length, 0))
        coming = np.diff(np.concatenate([[0], np.cumsum(sent)])[edges]).tolist()
        return table_of([(_NONE, r["part"], r["block"], out[a:b].tobytes(), n)
                         for r, a, b, n in zip(rows, edges[:-1], edges[1:], coming)], _CODES)

    return answer


def _order(values: np.ndarray) -> np.ndarray:
    """Places in the order of their values; a plain sort of value and place together is faster if both fit."""
    bits = max(1, len(values) - 1).bit_length()
    if not len(values) or int(values.max()).bit_length() + bits > 63:
        return np.argsort(values)
    both = (values.astype(np.int64) << bits) | np.arange(len(values))
    both.sort()
    return both & ((1 << bits) - 1)


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes at the given places in the order of their first ``depth`` bytes, and which of them
    are equal to the one before in all of these.

    Ranks by 8, 16, 32, ... bytes follow from one another by doubling, at the places that the wanted
    suffixes need; the last step overlaps.  Every place has ``depth`` >= 8 bytes left.
    """
    widths = [8]
    while 2 * widths[-1] <= depth:
        widths.append(2 * widths[-1])
    n, steps = len(data), [*widths[:-1], depth - widths[-1]]
    needed, mask = [at], np.zeros(n, bool)
    for step in reversed(steps):  # places whose ranks by 8, 16, ... bytes are used
        mask[needed[0]] = True
        mask[needed[0] + step] = True
        needed.insert(0, np.flatnonzero(mask))
    packed = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        packed = (packed[:-width] << _U(8 * width)) | packed[width:]
    value, rank = packed[needed[0]], np.zeros(n, np.int64)
    for places, following, step in zip(needed, needed[1:], steps):
        order = _order(value)
        in_order = value[order]
        rank[places[order]] = np.cumsum(np.concatenate([[False], in_order[1:] != in_order[:-1]]))
        value = rank[following] * len(places) + rank[following + step]
    order = _order(value)
    in_order = value[order]
    return order, np.concatenate([[False], in_order[1:] == in_order[:-1]])[:len(order)]


def earlier_matches(data: np.ndarray, lengths: np.ndarray, key: np.ndarray, length: int) -> np.ndarray:
    """For each place of the concatenated strings: does its longest previous factor, cut at
    ``length`` bytes, reach that length in a string of a smaller key?"""
    # Only suffixes of `length` bytes or more can hold or be such a match.
    count = np.maximum(lengths - length + 1, 0)
    at, string = spread(np.cumsum(lengths) - lengths, count), np.repeat(np.arange(len(lengths)), count)
    hit = np.zeros(len(data), bool)
    if not len(at):
        return hit
    order, joined = suffix_order(data, at, length)
    rank_key = key[string[order]]
    for forward in (False, True):
        keys, link = (rank_key[::-1], np.concatenate([[False], joined[1:][::-1]])) if forward else (rank_key, joined)
        # Previous smaller position: while the one before is not smaller, go on to the one before that.
        before = np.where(link, np.arange(len(keys)) - 1, -1)
        far = np.flatnonzero(link)
        while len(far):
            far = far[keys[before[far]] >= keys[far]]
            before[far] = before[before[far]]
            far = far[before[far] >= 0]
        found = before >= 0
        hit[at[order]] |= found[::-1] if forward else found
    return hit


def _answer_strings(length: int):
    def answer(table: pa.Table) -> pa.Table:
        """For each string of one shard the places, as bits, at which an earlier match covers a window."""
        rows = table.to_pylist()
        lengths = np.concatenate([np.frombuffer(r["lengths"], np.uint8) for r in rows]).astype(np.int64)
        keys = np.concatenate([np.frombuffer(r["keys"], np.int64) for r in rows])
        hit = earlier_matches(np.concatenate([np.frombuffer(r["bytes"], np.uint8) for r in rows]), lengths, keys, length)
        first = np.cumsum(lengths) - lengths
        mask = np.zeros(len(lengths), np.uint32)
        for i in range(32):
            inside = np.flatnonzero(i < lengths)
            mask[inside] |= hit[first[inside] + i].astype(np.uint32) << np.uint32(i)
        edges = np.cumsum([0] + [len(r["lengths"]) for r in rows])
        return table_of([(r["kind"], r["part"], r["block"], mask[a:b].tobytes(), 0) for r, a, b in zip(rows, edges[:-1], edges[1:])], _CODES)

    return answer


def _by_part(answers: pa.Table) -> dict[tuple[int, int], bytes]:
    return {(r["kind"], r["part"]): r["answer"] for r in answers.to_pylist()}


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
                   many: int = MANY_SURROUNDINGS, block_rows_log2: int = BLOCK_ROWS_LOG2) -> DataFrame:
    """(key, n_bytes, removed, kept) of every document: removed byte ranges and the remaining bytes.

    Texts are UTF-8 bytes and matches never cross documents.  A byte is removed if a string of
    ``length`` bytes that covers it also starts in a document with a smaller key, judged on the
    input; repeated rows of one key do not remove each other, and a null key is larger than all.  Null
    and empty texts are empty; an empty table gives an empty table.  The key is an integer, and
    length - gram is at most 31.  The input must be a stored table, which is read alike again.
    """
    assert 8 <= gram <= length <= gram + 31
    rows = docs.select(F.col(quoted(key)).cast("bigint").alias("key"), F.col(quoted(text)).alias("text")).withColumn(
        "block", block_number(block_rows_log2))
    parts = 8 + rows.count() // ROWS_PER_PART

    def ask(table: pa.Table) -> pa.Table:
        return Block(table, parts, length, gram).questions(table["block"][0].as_py())

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, parts, length, gram, shards)
        return block.strings(table["block"][0].as_py(), block.codes(_by_part(answers)))

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        block = Block(table, parts, length, gram, shards)
        gone = block.covered(_by_part(answers))
        removed, kept = [], []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            flags = np.concatenate([[False], gone[a:b], [False]])
            turn = np.flatnonzero(flags[1:] != flags[:-1])
            removed.append([{"start": s, "end": e} for s, e in zip(turn[::2].tolist(), turn[1::2].tolist())])
            kept.append(block.data[a:b][~gone[a:b]].tobytes())
        return pa.table({"key": table["key"], "n_bytes": np.diff(block.offsets),
                         "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                         "kept": pa.array(kept, pa.binary())})

    asked = map_blocks(rows, ask, _ASKED)
    codes = cut_lineage(asked.groupBy("part").applyInArrow(_answer_anchors(many, length, gram), _CODES))
    shards = 1 + (codes.agg(F.sum("coming")).first()[0] or 0) // SHARD_BYTES
    strings = rows.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(send, _STRINGS)
    # Not stored: the plan then shuffles the texts once for both steps that read them.
    masks = strings.groupBy("kind", "part").applyInArrow(_answer_strings(length), _CODES)
    done = rows.groupBy("block").cogroup(codes.unionByName(masks).groupBy("block")).applyInArrow(
        remove, "key bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary")
    return done.withColumnRenamed("key", key)
