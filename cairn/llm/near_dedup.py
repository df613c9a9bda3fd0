"""Near-duplicates by one-permutation MinHash, banded buckets and star-shaped candidates (operator 6).

Documents with equal shingle sets are one node, so a group of exact copies costs one node.  Each bucket
names as its centre the member that shares most buckets with others, and each node is compared with one
centre, the best of all its buckets: a star has one edge a node, however many buckets two nodes share.
Buckets that then still hold several components are closed exactly by ``similar_lists``: pairs of
different components that no filter excludes are verified on full sets in the first bucket they share,
and a task sends only links that join components.  So no pair of a bucket is lost to the choice of a
centre, and no bucket gives more rows than it has members.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.sets import ROW, components, maybe_among, shingle_sets, verify
from cairn.llm.similar_lists import SIGNATURE_DEVIATIONS, joining_links, one_center_each, sets_of
from cairn.llm.words import given_names, map_texts, mix, neutral_names, quoted, utf8
from cairn.session import cut_lineage

SHINGLE = 5
#: 40 bands of 6: two sets of similarity 0.85 miss all bands once in 10^8 pairs.
BANDS, ROWS = 40, 6


@lru_cache(maxsize=4)
def _donors(bins: int) -> np.ndarray:
    """For each bin, the turn at which its own random sequence of bins comes to every bin."""
    rng = np.random.default_rng(bins)
    return np.argsort(np.argsort(rng.random((bins, bins)), axis=1), axis=1).astype(np.int32)


def signature(sorted_set: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash with optimal densification.

    One hash deals the elements to the bins and orders them there.  An empty bin takes the value of
    the first filled bin in its own random sequence, which depends on the bin alone, so two sets
    choose alike as often as they are alike.
    """
    values = mix(sorted_set ^ np.uint64(0xA5A5F00D12345678))
    values.sort()
    bin_of = ((values >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(bin_of, return_index=True)
    out = np.empty(bins, np.uint64)
    filled = filled.astype(np.int64)
    out[filled] = values[first]
    if len(filled) < bins:
        empty = np.setdiff1d(np.arange(bins), filled, assume_unique=True)
        turns = _donors(bins)[np.ix_(empty, filled)]
        out[empty] = out[filled[turns.argmin(axis=1)]]
    return out


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    table = sign.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for j in range(rows):
        out = mix(out ^ table[:, j]) + np.uint64(j)
    return out


def _sketches(docs: DataFrame, text: str, keep: list[str], n: int, bands: int, rows: int) -> DataFrame:
    def compute(data, offsets, batch):
        sets = shingle_sets(data, offsets, n)
        prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        signs = [signature(s, bands * rows) if len(s) else np.zeros(0, np.uint64) for s in sets]
        keys = [band_keys(s, bands, rows) if len(s) else s for s in signs]
        where = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
        flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()),
                pa.array([s.astype(np.uint8).tobytes() for s in signs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(where), pa.array(flat.view(np.int64)))]

    return map_texts(docs, "n_shingles bigint, print binary, sketch binary, bands array<bigint>", compute, text, keep)


def _stored_sets(docs: DataFrame, text: str, nodes: DataFrame, n: int) -> DataFrame:
    """(node, set): the full sets of the candidate nodes, read from their first rows' texts."""
    def compute(data, offsets, batch):
        return [pa.array([s.tobytes() for s in shingle_sets(data, offsets, n)], pa.binary())]

    rows = maybe_among(docs, nodes).filter("__maybe").select(F.col(ROW).alias("node"), text)
    return map_texts(rows, "set binary", compute, text, ["node"]).join(nodes, "node", "left_semi")


def _promising(edges: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Edges without those whose signatures are so far apart that no linked pair's would be.

    A byte of each signature value is compared.  The share of equal ones strays from the similarity by
    its standard error, which small sets bound by their own size; six of them are allowed, so this
    passes over a link less than once in 10^8 pairs, like the bands.
    """
    both = (edges.join(sketches.select(F.col("node").alias("member"), F.col("sketch").alias("sketch_b")), "member")
            .join(sketches.select(F.col("node").alias("center"), F.col("sketch").alias("sketch_a")), "center")
            .select("center", "member", "n", "sketch_a", "sketch_b"))
    least = percent / 100

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (utf8(batch.column(i))[0].reshape(batch.num_rows, -1) for i in (3, 4))
            slots = np.minimum(batch.column(2).to_numpy(), a.shape[1])
            near = (a == b).mean(axis=1) >= least - SIGNATURE_DEVIATIONS * np.sqrt(least * (1 - least) / slots)
            yield batch.select([0, 1]).filter(pa.array(near))

    return both.mapInArrow(compare, "center bigint, member bigint")


def _linked(buckets: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, label) of all nodes that have a link; buckets has (bucket, node, n) with two nodes or more."""
    entries = cut_lineage(buckets.select(F.col("bucket").alias("token"), "node", "n"))
    stars = cut_lineage(one_center_each(entries, percent))
    sizes = entries.select(F.col("node").alias("member"), "n").distinct()
    near = cut_lineage(_promising(stars.join(sizes, "member"), sketches, percent))
    stored = sets.withColumnRenamed("node", ROW)
    labels = cut_lineage(components(verify(sets_of(stored, near.select(F.col("center").alias("node")).unionAll(near.select("member"))), near, percent)))
    in_buckets = entries.groupBy("node").agg(F.array_sort(F.collect_list("token")).alias("tokens"))  # BANDS at most
    about = cut_lineage(in_buckets.join(sketches, "node").select(F.col("node").alias(ROW), "tokens", F.col("sketch").alias("about"))
                        .withColumn("first", F.lit(None).cast("int")))
    full = about.drop("about").join(stored.select(ROW, F.col("set").alias("about")), ROW)
    links = cut_lineage(joining_links(entries, labels, stars, about, full, "signature", percent))
    if links.isEmpty():
        return labels
    known = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
    return cut_lineage(components(links.unionByName(known)))


def _classes(docs: DataFrame, text: str, key: str, percent: int, n: int, bands: int, rows: int) -> DataFrame:
    """Row id, key, ``n_shingles`` and the component's label and smallest (key, row) of every row."""
    narrow = docs.select(ROW, F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text"))
    sketches = cut_lineage(_sketches(narrow, "text", [ROW, "key"], n, bands, rows))
    filled = sketches.filter("n_shingles > 0")
    nodes = cut_lineage(filled.groupBy("print").agg(
        F.min(ROW).alias("node"), F.min("key").alias("key"), F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    keys = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    several = keys.groupBy("bucket").agg(F.min("node").alias("l"), F.max("node").alias("h")).filter("l < h").select("bucket")
    buckets = cut_lineage(keys.join(several, "bucket", "left_semi"))
    candidates = buckets.select("node").distinct()
    compared = cut_lineage(nodes.select("node", "sketch").join(candidates, "node", "left_semi"))
    sets = cut_lineage(_stored_sets(narrow, "text", candidates, n))
    labels = _linked(buckets, compared, sets, percent)
    named = nodes.select("print", "node", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut_lineage(named.select("print", "key", "label"))
    smallest = named.groupBy("label").agg(F.min("key").alias("component_key"))
    of_print = named.select("print", "label").join(smallest, "label")
    return sketches.select(ROW, "key", "n_shingles", "print").join(of_print, "print", "left")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, n: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every document.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of n-word
    shingles (A-Z lowered, words between ASCII blanks; fewer words are one shingle).  Null, empty and
    blank texts have no shingles and no links: each is its own component.  ``component_id`` is the
    smallest key of the component, null only if no member has one; ``kept`` says that the row's key
    is that key, so repeated rows of one key are kept alike.  The input must be a stored table or
    another plan whose rows come in the same order when they are read again.
    """
    docs = docs.select(quoted(key), quoted(text)).withColumn(ROW, F.monotonically_increasing_id())
    found = _classes(docs, text, key, percent, n, bands, rows)
    component = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("component_key"))
    return found.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"),
                        F.col("key").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 85, n: int = SHINGLE,
                     bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest key.

    Repeated rows of that key leave one; a null key stays only if no member has another.  Documents
    without shingles stay.  Columns stay as they are, whatever their names; the input must be a stored table.
    """
    plain, names = neutral_names(docs)
    marked = plain.withColumn(ROW, F.monotonically_increasing_id())
    found = cut_lineage(_classes(marked, names[text], names[key], percent, n, bands, rows).select(ROW, "key", "label", "component_key"))
    kept = (found.filter("label IS NOT NULL AND key <=> component_key").groupBy("label").agg(F.min(ROW).alias("kept")))
    dropped = cut_lineage(found.filter("label IS NOT NULL").join(kept, "label", "left")
                          .filter(f"NOT ({ROW} <=> kept)").select(F.col(ROW).alias("node")))
    # Most rows are known to stay without a shuffle; the others are looked up.
    flagged = maybe_among(marked, dropped)
    sure = flagged.filter("NOT __maybe")
    looked_up = flagged.filter("__maybe").join(dropped, F.col(ROW) == F.col("node"), "left_anti")
    return given_names(sure.unionByName(looked_up), names)
