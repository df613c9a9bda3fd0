"""Jaccard join on word n-grams by rare-first prefix filtering (operator 12).

1. Blocks of rows send the hashes of their distinct n-grams to parts of the hash range, which answer with
   document frequencies.  Every set is then put in one order, rare n-grams first.  Two sets whose Jaccard
   similarity is a threshold t or more share an n-gram among their first n - ceil(t * n) + 1 ones (the
   prefix), so sets meet by equal prefix n-grams only, and n-grams of one document need not be sent.
2. Each set is compared with one other set of its lists, the one that shares most.  What this links is one
   component.
3. Lists that then hold several components are closed exactly: of all pairs of different components, the
   length filter, the positional filter (how much can still be common after this n-gram) and the suffix
   filter (parity bits of both sets, XORed, bound their difference from below) leave the candidates.  A
   pair is a candidate at its first common prefix n-gram alone, so it is verified once, on full sets.

Equal sets are one node.  Long lists are dealt to tasks in pairs of chunks, chunks of the largest
component only against chunks of the others.  A task sends the links that join components, at most one
for each member; so a group of k near copies gives about k rows for each list, and no link between
different components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.skew import salted_lookup_join
from cairn.llm.blocks import table_of
from cairn.llm.sets import ROW, components, shingle_sets, verify
from cairn.llm.similar_lists import folded, joining_links, least_overlap, one_center_each, parity_bits, sets_of
from cairn.llm.words import quoted, slices, utf8
from cairn.session import cut_lineage

SHINGLE, PERCENT = 3, 90
#: Rows of a block; a text of more bytes is a block of its own.
BLOCK_ROWS_LOG2, LONG_TEXT = 12, 1 << 16
#: A part gets the n-grams of about so many documents.
ROWS_PER_PART = 4096
#: Rows of one text beyond which they get their component in several tasks.
COPIES_PER_TASK = 4096

_U = np.uint64
_ASKED = "part bigint, block bigint, single binary, more binary, counts binary"
_TOLD = "part bigint, block bigint, levels binary"


# --- document frequencies -----------------------------------------------------------------------------

def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)


def _distinct_sets(table: pa.Table, n: int) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """(place in the table, digest, set) of every row."""
    at = 0
    for batch in table.combine_chunks().to_batches():
        for part in slices(batch, "text", 2 << 20):
            for own in shingle_sets(*utf8(part.column(part.schema.get_field_index("text"))), n):
                yield at, hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own
                at += 1


def _block_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a block and in how many of its different sets each is."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)


def _ask(parts: int, n: int) -> Callable[[pa.Table], pa.Table]:
    def ask(table: pa.Table) -> pa.Table:
        keys, counts = _block_keys(list({print_: own for _, print_, own in _distinct_sets(table, n)}.values()))
        of, block, rows = _part_of(keys, parts), table["block"][0].as_py(), []
        edges = np.searchsorted(of, np.arange(parts + 1))
        for p in np.unique(of).tolist():
            low, c = keys[edges[p]:edges[p + 1]].astype(np.uint32), counts[edges[p]:edges[p + 1]]
            rows.append((p, block, low[c == 1].tobytes(), low[c > 1].tobytes(), c[c > 1].astype(np.uint16).tobytes()))
        return table_of(rows, _ASKED)

    return ask


def _answer(table: pa.Table) -> pa.Table:
    """Levels of document frequency, 0 for n-grams of one set, in the order in which each block asked."""
    asked = []
    for row in table.to_pylist():
        single, more, counts = np.frombuffer(row["single"], np.uint32), np.frombuffer(row["more"], np.uint32), np.frombuffer(row["counts"], np.uint16)
        asked.append((row["part"], row["block"], np.concatenate([single, more]), np.concatenate([np.ones(len(single), np.uint32), counts])))
    keys, place = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
    total = np.bincount(place, np.concatenate([a[3] for a in asked]), len(keys))
    level = np.where(total < 2, 0, np.minimum(8 * np.log2(np.maximum(total, 1)), 255)).astype(np.uint8)
    edges = np.concatenate([[0], np.cumsum([len(a[2]) for a in asked])])
    told = level[place]
    return table_of([(a[0], a[1], told[x:y].tobytes()) for a, x, y in zip(asked, edges[:-1], edges[1:])], _TOLD)


def _by_block(rows: DataFrame, ask: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``ask`` applied to every block where it lies; rows with a negative block are blocks of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            for i in np.flatnonzero(blocks < 0).tolist():
                yield from ask(pa.Table.from_batches([batch.slice(i, 1)])).to_batches()
            batch = batch.filter(pa.array(blocks >= 0))
            blocks = blocks[blocks >= 0]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]]).tolist()
            for a, b in zip(edges[:-1], edges[1:]):
                if b > a and held and held[0].column(held[0].schema.get_field_index("block"))[0].as_py() != blocks[a]:
                    yield from ask(pa.Table.from_batches(held)).to_batches()
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from ask(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, ddl)


# --- sets in rare-first order ---------------------------------------------------------------------------

def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


_SET = "n_shingles bigint, print binary, first int, tokens array<bigint>, elements binary, bits binary"


def _rare_first(parts: int, n: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def order(mine: pa.Table, told: pa.Table) -> pa.Table:
        rows = mine[ROW].to_numpy()
        found = [(rows[at], print_, own) for at, print_, own in _distinct_sets(mine, n)]
        least: dict[bytes, int] = {}
        for row, print_, _ in found:
            least[print_] = min(row, least.get(print_, row))
        sets = {print_: own for _, print_, own in found}
        keys, counts = _block_keys(list(sets.values()))
        levels = np.empty(len(keys), np.uint8)
        answers = [b for _, b in sorted(zip(told["part"].to_pylist(), told["levels"].to_pylist()))]
        levels[np.lexsort((counts > 1, _part_of(keys, parts)))] = np.frombuffer(b"".join(answers), np.uint8)
        sizes, prints, firsts, tokens, elements, bits = ([] for _ in range(6))
        for row, print_, own in found:
            level = levels[np.searchsorted(keys, own)] if len(own) else np.zeros(0, np.uint8)
            alone = int((level == 0).sum())
            end = prefix_length(len(own), percent) if len(own) else 0
            sizes.append(len(own))
            prints.append(print_)
            if row != least[print_] or alone >= end:
                for column in (firsts, tokens, elements, bits):
                    column.append(None)
                continue
            shared = np.flatnonzero(level)
            shared = own[shared[np.lexsort((own[shared], level[shared]))[:end - alone]]]
            firsts.append(alone)
            tokens.append(shared.view(np.int64))
            elements.append(own.tobytes())
            bits.append(parity_bits(own))
        return pa.table({
            ROW: mine[ROW], "key": mine["key"], "n_shingles": pa.array(sizes, pa.int64()), "print": pa.array(prints, pa.binary()),
            "first": pa.array(firsts, pa.int32()), "tokens": pa.array(tokens, pa.list_(pa.int64())),
            "elements": pa.array(elements, pa.binary()), "bits": pa.array(bits, pa.binary())})

    return order



def _near_by_bits(edges: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """(center, member) edges that the length and the suffix filter leave."""
    both = (edges.join(bits.select(F.col("node").alias("member"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b")), "member")
            .join(bits.select(F.col("node").alias("center"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a")), "center")
            .select("center", "member", "n_a", "n_b", "bits_a", "bits_b"))

    def compare(batches):
        for batch in batches:
            near = []
            for n_a, n_b, a, b in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                a, b = (np.frombuffer(x, np.uint64).reshape(1, -1) for x in (a, b))
                while a.shape[1] > b.shape[1]:
                    a = folded(a)
                while b.shape[1] > a.shape[1]:
                    b = folded(b)
                near.append(int(np.bitwise_count(a ^ b).sum()) <= n_a + n_b - 2 * least_overlap(n_a + n_b, percent))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(compare, "center bigint, member bigint")


def _labels(found: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the nodes that have a link; ``found`` has the sets, ``nodes`` (node) one row of equal ones."""
    sets = found.filter("tokens IS NOT NULL")
    keys = (sets.select(F.col(ROW).alias("node"), F.col("n_shingles").alias("n"), "tokens").join(nodes, "node", "left_semi")
            .select("node", "n", F.explode("tokens").alias("token")))
    several = keys.groupBy("token").agg(F.min("node").alias("l"), F.max("node").alias("h")).filter("l < h").select("token")
    entries = cut_lineage(keys.join(several, "token", "left_semi"))
    bits = sets_of(sets.select(ROW, F.col("n_shingles").alias("n"), "bits"), entries)
    stars = cut_lineage(one_center_each(entries, percent))
    near = cut_lineage(_near_by_bits(stars, bits, percent))
    ends = near.select(F.col("center").alias("node")).unionAll(near.select("member"))
    full = sets.select(ROW, "first", "tokens", F.col("elements").alias("about"))
    labels = cut_lineage(components(verify(sets_of(full.select(ROW, F.col("about").alias("set")), ends), near, percent)))
    about = sets.select(ROW, "first", "tokens", F.col("bits").alias("about"))
    links = cut_lineage(joining_links(entries, labels, stars, about, full, "bits", percent))
    if links.isEmpty():
        return labels
    return cut_lineage(components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))))


def linked_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """(key, n_shingles, component_id) of every document.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of n-word
    shingles (A-Z lowered, words between ASCII blanks; fewer words are one shingle).  Null, empty and
    blank texts have no shingles and no links: each is its own component.  ``component_id`` is the
    smallest key of the component, null only if no member has one.  Repeated rows are equal sets.  Other
    columns are not read; an empty table gives an empty table.  The input must be a stored table or
    another plan whose rows come in the same order when they are read again.
    """
    row = F.monotonically_increasing_id()
    block = F.when(F.octet_length("text") > LONG_TEXT, -1 - F.col(ROW)).otherwise(F.shiftright(ROW, BLOCK_ROWS_LOG2))
    rows = docs.select(row.alias(ROW), F.col(quoted(key)).alias("key"), F.col(quoted(text)).alias("text")).withColumn("block", block)
    parts = 8 + docs.count() // ROWS_PER_PART
    told = cut_lineage(_by_block(rows.select("block", "text"), _ask(parts, n), _ASKED).groupBy("part").applyInArrow(_answer, _TOLD))
    schema = f"{ROW} bigint, key {docs.schema[key].dataType.simpleString()}, {_SET}"
    found = cut_lineage(rows.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_rare_first(parts, n, percent), schema))
    filled = found.filter("n_shingles > 0")
    nodes = cut_lineage(filled.groupBy("print").agg(F.min(ROW).alias("node"), F.min("key").alias("key"), F.count(F.lit(1)).alias("copies")))
    labels = _labels(found, nodes.select("node"), percent)
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut_lineage(named.filter("copies > 1 OR label IS NOT NULL").select("print", "label", "key"))
    smallest = named.groupBy("label").agg(F.min("key").alias("component_key"))
    of_print = named.select("print", "label").join(smallest, "label")
    copies = nodes.select("print", F.col("copies").alias("members"))
    told = salted_lookup_join(found.select(ROW, "key", "n_shingles", "print"), of_print, copies, ["print"], ROW, COPIES_PER_TASK)
    component = F.when(F.col("label").isNull(), F.col("key")).otherwise(F.col("component_key"))
    return told.select(F.col("key").alias(key), "n_shingles", component.alias("component_id"))
