"""Components of lists of similar sets, without the pairs of a list ever being rows.

Sets meet in lists (equal prefix n-grams, equal buckets), and a linked pair shares a list.  A first link for
most members comes from stars (``one_center_each``).  Lists that then hold several components are closed
exactly (``joining_links``): of all pairs of different components, filters on sizes, places and sketches
leave the candidates; a pair is a candidate in the first list it shares alone, so it is verified once, on
full sets; and a task sends only links that join components, at most one for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.sets import ROW, maybe_among
from cairn.llm.words import mix
from cairn.session import cut_lineage

#: A list of more members is dealt to tasks in pairs of chunks of about so many.
CHUNK = 1024
#: Standard errors by which signatures may fall short of the similarity that is asked for.
SIGNATURE_DEVIATIONS = 6

_U = np.uint64


def least_overlap(total, percent: int):
    """How many elements two sets of together ``total`` share at least if they are linked."""
    return -(-percent * total // (100 + percent))


def parity_bits(elements: np.ndarray) -> bytes:
    """Bit j says whether an odd number of elements fall on it; four bits or more for each element.

    Elements that two sets share cancel out when their bits are XORed, so the bits left are no more than
    the elements that only one of them has.
    """
    width = max(64, 1 << (4 * len(elements) - 1).bit_length())
    place = (mix(elements ^ _U(0x5BD1E995C2B2AE35)) & _U(width - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=width).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """The parity bits (rows of words) for half as many bits."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:] if half else bits


class ParityFilter:
    """Pairs whose sets differ in more elements than linked ones may are passed over; no link is lost."""

    def __init__(self, bits: list[bytes]):
        self.width = np.array([len(b) for b in bits])
        self.bits, self.half, self.row = {}, {}, np.zeros(len(bits), np.int64)
        for w in np.unique(self.width).tolist():
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))
            self.bits[w] = np.frombuffer(b"".join(bits[i] for i in own), np.uint64).reshape(len(own), -1)
            self.half[w] = folded(self.bits[w])

    def near(self, i: int, j: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Which sets j differ from set i in no more than ``apart`` elements, as far as the bits tell."""
        keep, w = np.zeros(len(j), bool), self.width[i]
        for other in np.unique(self.width[j]).tolist():
            of = np.flatnonzero(self.width[j] == other)
            mine = self.half[w][self.row[i]] if other < w else self.bits[w][self.row[i]]
            theirs = (self.half if other > w else self.bits)[other][self.row[j[of]]]
            if len(mine) != theirs.shape[1]:  # sizes more than twice apart
                keep[of] = True
                continue
            keep[of] = np.bitwise_count(theirs ^ mine).sum(axis=1) <= apart[of]
        return keep


class SignatureFilter:
    """Pairs whose MinHash signatures agree too rarely are passed over.

    A byte of each value is compared.  The share of equal ones strays from the similarity by its
    standard error, which small sets bound by their own size; six of them are allowed, so this passes
    over a link less than once in 10^8 pairs.
    """

    def __init__(self, signatures: list[bytes], percent: int):
        self.bytes = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), -1)
        self.least = percent / 100

    def near(self, i: int, j: np.ndarray, apart: np.ndarray, n: np.ndarray) -> np.ndarray:
        equal = (self.bytes[j] == self.bytes[i]).mean(axis=1)
        slots = np.minimum(np.minimum(n[j], n[i]), self.bytes.shape[1])
        return equal >= self.least - SIGNATURE_DEVIATIONS * np.sqrt(self.least * (1 - self.least) / slots)


class Members:
    """Members of one list, or of two chunks of it, as arrays.

    ``tokens`` are the names of each member's lists in an order common to all; ``first`` is the place of
    the first of them among the set's elements, if the lists are elements, else null.
    """

    def __init__(self, rows: list[tuple], kind: str, percent: int):
        token, i, j, chunk, node, label, n, first, center, tokens, about = zip(*rows)
        self.node, self.label, self.n, self.chunk = (np.array(c, np.int64) for c in (node, label, n, chunk))
        self.token, self.one_chunk, self.percent, self.about = token[0], i[0] == j[0], percent, about
        self.center = np.array([-1 if c is None else c for c in center], np.int64)
        tokens = [np.array(t, np.int64) for t in tokens]
        at = [int(np.flatnonzero(t == token[0])[0]) for t in tokens]
        # What can be common besides the earlier lists: this element and those after it.
        self.most = np.array([size if f is None else size - f - k for size, f, k in zip(n, first, at)], np.int64)
        before = [t[:k] for t, k in zip(tokens, at)]
        every, count = np.unique(np.concatenate([np.zeros(0, np.int64), *before]), return_counts=True)
        every = every[count > 1]
        self.earlier = np.zeros((len(tokens), -(-len(every) // 64)), np.uint64)
        if len(every):
            for k, t in enumerate(before):
                own = np.searchsorted(every, t)
                own = own[every[np.minimum(own, len(every) - 1)] == t]
                np.bitwise_or.at(self.earlier[k], own >> 6, _U(1) << (own & 63).astype(np.uint64))
        if kind == "signature":
            self.filter = SignatureFilter(about, percent)
        else:
            self.filter = ParityFilter(about if kind == "bits" else [parity_bits(np.frombuffer(a, np.uint64)) for a in about])

    def linkable(self, i: int) -> np.ndarray:
        """Later members of other components that no filter keeps from a link with member i."""
        j = np.arange(i + 1, len(self.n))
        ok = self.label[j] != self.label[i]
        if not self.one_chunk:
            ok &= self.chunk[j] != self.chunk[i]
        ok &= 100 * np.minimum(self.n[j], self.n[i]) >= self.percent * np.maximum(self.n[j], self.n[i])
        j = j[ok]
        total = self.n[j] + self.n[i]
        least = least_overlap(total, self.percent)
        ok = np.minimum(self.most[j], self.most[i]) >= least
        ok &= (self.center[j] != self.node[i]) & (self.center[i] != self.node[j])
        if self.earlier.shape[1]:
            ok &= ~(self.earlier[j] & self.earlier[i]).any(axis=1)
        j, apart = j[ok], (total - 2 * least)[ok]
        return j[self.filter.near(i, j, apart, self.n)] if len(j) else j


_MEMBER = ("token", "i", "j", "chunk", "node", "label", "n", "first", "center", "tokens", "about")


def _lists(batches: Iterator[pa.RecordBatch], kind: str, percent: int) -> Iterator[Members]:
    """Consecutive rows of one (token, i, j)."""
    held = []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _MEMBER)):
            if held and held[0][:3] != row[:3]:
                if len(held) > 1:
                    yield Members(held, kind, percent)
                held = []
            held.append(row)
    if len(held) > 1:
        yield Members(held, kind, percent)


def _survivors(kind: str, percent: int):
    """(token, node) of the members of any pair that has to be verified."""
    def run(batches):
        for m in _lists(batches, kind, percent):
            found = np.zeros(len(m.n), bool)
            for i in range(len(m.n) - 1):
                j = m.linkable(i)
                found[j] = True
                found[i] |= len(j) > 0
            if found.any():
                nodes = m.node[found]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), m.token)), pa.array(nodes)], ["token", "node"])

    return run


def _verified(percent: int):
    """Links, on full sets, between members that no link found before has joined."""
    def run(batches):
        for m in _lists(batches, "elements", percent):
            sets = [np.frombuffer(e, np.uint64) for e in m.about]
            top = {label: label for label in m.label.tolist()}

            def find(x):
                while top[x] != x:
                    top[x] = x = top[top[x]]
                return x

            links = []
            for i in range(len(sets) - 1):
                for j in m.linkable(i).tolist():
                    a, b = find(m.label[i]), find(m.label[j])
                    if a == b:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        top[a] = b
                        links.append((m.node[i], m.node[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _dealt(entries: DataFrame) -> DataFrame:
    """Rows of open lists (token, node, label, ...) with the pairs (i, j) of chunks that they go to.

    Lists of up to CHUNK members are one chunk.  In longer ones the largest component has chunks of its
    own, which meet only those of the others.
    """
    sizes = entries.groupBy("token", "label").agg(F.count(F.lit(1)).alias("members"))
    lists = (sizes.groupBy("token").agg(F.sum("members").alias("size"), F.max(F.struct("members", "label")).alias("m"), F.count(F.lit(1)).alias("several"))
             .filter("several > 1").select("token", "size", F.col("m.label").alias("most"), F.col("m.members").alias("main")))
    lists = lists.withColumns({"outer": F.expr(f"CAST(ceil((size - main) / {CHUNK}) AS INT)"), "inner": F.expr(f"CAST(ceil(main / {CHUNK}) AS INT)")})
    rows = entries.join(cut_lineage(lists), "token")
    chunk = F.expr(f"""CASE WHEN size <= {CHUNK} THEN 0 WHEN label = most THEN outer + CAST(pmod(xxhash64(node), inner) AS INT)
                       ELSE CAST(pmod(xxhash64(node), outer) AS INT) END""")
    other = F.expr(f"CASE WHEN size <= {CHUNK} THEN array(0) WHEN label = most THEN sequence(0, outer - 1) ELSE sequence(0, outer + inner - 1) END")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(other))
    return rows.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("size", "most", "main", "outer", "inner", "other")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.select(*_MEMBER).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node")


def one_center_each(entries: DataFrame, percent: int) -> DataFrame:
    """(center, member): for each node the member of its lists that shares most list places with others.

    Of the copies of one text, the one nearest to all others shares most.  ``entries`` has (token, node, n)
    and must be stored, so that lists with many members can be split.
    """
    sizes = cut_lineage(entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")))
    popular = cut_lineage(entries.join(sizes, "token").groupBy("node").agg(F.sum("size").alias("popularity")))
    rated = entries.join(popular, "node")
    centers = cut_lineage(rated.groupBy("token").agg(F.max(F.struct("popularity", "node", "n")).alias("c")))
    alike = f"c.node <> node AND 100 * least(c.n, n) >= {percent} * greatest(c.n, n)"
    return (entries.join(centers, "token").filter(alike).groupBy("node").agg(F.max("c").alias("c"))
            .select(F.col("c.node").alias("center"), F.col("node").alias("member")))


def sets_of(stored: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``stored`` among ids (node), by their number; most others do not leave their place."""
    return maybe_among(stored, ids).filter("__maybe").drop("__maybe").withColumnRenamed(ROW, "node")


def joining_links(entries: DataFrame, labels: DataFrame, stars: DataFrame, about: DataFrame, full: DataFrame, kind: str,
                  percent: int) -> DataFrame:
    """Links (a, b) that join all components of ``labels`` (node, label) that share a linked pair.

    ``stars`` (center, member) are the pairs that were compared before.  ``about`` has (ROW, first,
    tokens, about) of every node, where ``about`` is its parity bits or its signature, as ``kind`` says;
    ``full`` has its sorted set there.
    """
    rows = (entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            .join(stars.withColumnRenamed("member", "node"), "node", "left"))
    lists = cut_lineage(_dealt(rows))
    open_ = _grouped(lists.join(sets_of(about, lists.select("node")), "node"))
    left = cut_lineage(open_.mapInArrow(_survivors(kind, percent), "token bigint, node bigint").distinct())
    again = _dealt(rows.join(left, ["token", "node"], "left_semi"))
    sets = sets_of(full, left.select("node"))
    return _grouped(again.join(sets, "node")).mapInArrow(_verified(percent), "a bigint, b bigint")
