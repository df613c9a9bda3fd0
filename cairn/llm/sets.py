"""Sets of n-grams as sorted hashes: making them, comparing them on full sets, and components of links."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import LOWER, NOT_BLANK, Sums, Words, grams
from cairn.session import cut_lineage

#: A centre with more members is compared in several tasks.
MEMBERS_PER_TASK = 4096
#: Bits of the filter that keeps rows from needless shuffles.
FILTER_LOG2 = 22
ROW = "__row"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each document's n-word shingles; fewer words are one shingle."""
    data = LOWER[data]
    words = Words(data, offsets, NOT_BLANK)
    hashes = Sums(data).of(words.start, words.end)
    whole = grams(hashes, n)
    out = []
    for a, b in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(whole[a:b - n + 1]))
        else:  # the number of words tells short texts from each other and from shingles
            out.append(grams(hashes[a:b], b - a) ^ np.uint64(b - a) if b > a else np.zeros(0, np.uint64))
    return out


def maybe_among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with ``__maybe``: false only if the row's number is not among the ids.

    A bit for each of 2^FILTER_LOG2 hash values, 64 to a word: a table of at most 65,536 rows whatever
    the input, which spares most rows the shuffle of an exact join.
    """
    size = 1 << FILTER_LOG2

    def place(c: str):
        return F.pmod(F.xxhash64(c), F.lit(size))

    bit = F.expr("shiftleft(1L, cast(place % 64 AS int))")
    words = (ids.select(place("node").alias("place")).groupBy(F.floor(F.col("place") / 64).alias("__word"))
             .agg(F.bit_or(bit).alias("__bits")))
    asked = rows.withColumn("__place", place(ROW)).withColumn("__word", F.floor(F.col("__place") / 64))
    hit = F.expr("shiftrightunsigned(__bits, cast(__place % 64 AS int)) & 1L") == 1
    return asked.join(F.broadcast(words), "__word", "left").withColumn("__maybe", F.coalesce(hit, F.lit(False))).drop(
        "__word", "__place", "__bits")


def verify(sets: DataFrame, edges: DataFrame, percent: int) -> DataFrame:
    """The (centre, member) edges whose full sets have 100 * intersection >= percent * union.

    Every set goes to the centres that it is compared with, the centre's own set first; a task reads
    its rows in order and holds one centre's set at a time.
    """
    parts = edges.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).cast("int").alias("parts"))
    to = edges.join(parts, "center").select(
        "center", F.col("member").alias("node"), F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"),
        F.lit(True).alias("is_member"))
    own = parts.select("center", F.col("center").alias("node"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"),
                       F.lit(False).alias("is_member"))
    rows = sets.join(to.unionByName(own), "node").repartition("center", "part").sortWithinPartitions("center", "part", "is_member")

    def compare(batches):
        center, held = None, None
        for batch in batches:
            at = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            centers, nodes, members = (at[c].to_numpy(zero_copy_only=False) for c in ("center", "node", "is_member"))
            found = []
            for i in range(len(centers)):
                elements = np.frombuffer(at["set"][i].as_buffer(), np.uint64)
                if not members[i]:
                    center, held = centers[i], elements
                    continue
                assert center == centers[i]
                place = np.searchsorted(held, elements)
                both = int((held[np.minimum(place, len(held) - 1)] == elements).sum())
                if 100 * both >= percent * (len(held) + len(elements) - both):
                    found.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(centers[found], pa.int64()), pa.array(nodes[found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(compare, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component, for nodes that have an edge.

    Large-star and small-star steps in turn, until no edge changes; each needs a minimum per node
    (combined before the shuffle) and a join with it.
    """
    edges = cut_lineage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        roots.select("node", F.col("node").alias("label")))
