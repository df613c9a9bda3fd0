"""A trie of shared conversation prefixes by adaptive radix trees (operator 11).

A turn has a fixed-width id, the digest of its role and text, read as big-endian bytes; a conversation is
the string of its turns' ids.  A task feeds the conversations of its partition to an adaptive radix tree:
inner nodes hold 4, 16, 48 or 256 children and grow to the next layout when they are full, and bytes that
have no branch are compressed into one step.  Only byte depths at the end of a turn give trie nodes.  A
tree that has grown to its byte limit gives its nodes and starts anew, so a task holds one tree of a
known size; the nodes of all trees then meet by the digest of their prefix, already summed, so a first
turn that a third of all conversations share is one row for each tree.

Sums over a subtree need every distinct node once.  A node belongs to the smallest conversation that has
it; that conversation owns a chain of nodes down to its last turn, so what a chain adds to the nodes
above it is one number, known at its conversation, and a second pass through the trees adds them up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.words import quoted
from cairn.session import cut_lineage

TURN_BYTES = 16
#: A tree is given out and begun anew beyond so many bytes of keys.
TREE_BYTES = 4 << 20
#: Ends of one node are joined in pieces of about so many conversations.
ENDS_PER_PIECE = 4096
BATCH_ROWS = 8192
_ROOT = hashlib.blake2b(b"", digest_size=TURN_BYTES).digest()


class _Sorted:
    """Up to ``room`` children beside their bytes in order: the layouts of 4 and of 16."""

    __slots__ = ("bytes", "nodes", "room")

    def __init__(self, room: int):
        self.bytes, self.nodes, self.room = bytearray(), [], room

    def get(self, byte: int):
        at = bisect_left(self.bytes, byte)
        return self.nodes[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node) -> bool:
        """Sets a child; false if there is no room for a new one."""
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.nodes[at] = node
        elif len(self.bytes) == self.room:
            return False
        else:
            self.bytes.insert(at, byte)
            self.nodes.insert(at, node)
        return True

    def items(self):
        return zip(self.bytes, self.nodes)


class _Indexed:
    """Up to 48 children, found by an index of 256 bytes."""

    __slots__ = ("index", "nodes")

    def __init__(self):
        self.index, self.nodes = bytearray(256), []

    def get(self, byte: int):
        return self.nodes[self.index[byte] - 1] if self.index[byte] else None

    def put(self, byte: int, node) -> bool:
        if self.index[byte]:
            self.nodes[self.index[byte] - 1] = node
        elif len(self.nodes) == 48:
            return False
        else:
            self.nodes.append(node)
            self.index[byte] = len(self.nodes)
        return True

    def items(self):
        return ((b, self.nodes[self.index[b] - 1]) for b in range(256) if self.index[b])


class _Full:
    """A child for every byte."""

    __slots__ = ("nodes",)

    def __init__(self):
        self.nodes = [None] * 256

    def get(self, byte: int):
        return self.nodes[byte]

    def put(self, byte: int, node) -> bool:
        self.nodes[byte] = node
        return True

    def items(self):
        return ((b, n) for b, n in enumerate(self.nodes) if n is not None)


def _grown(layout):
    """The next larger layout with the same children."""
    larger = _Sorted(16) if isinstance(layout, _Sorted) and layout.room == 4 else _Indexed() if isinstance(layout, _Sorted) else _Full()
    for byte, node in layout.items():
        larger.put(byte, node)
    return larger


class _Node:
    """A step: the bytes that lead to it, its children, and the conversations that end here."""

    __slots__ = ("path", "children", "ends")

    def __init__(self, path: bytes):
        self.path, self.children, self.ends = path, _Sorted(4), []

    def put(self, child: _Node) -> None:
        while not self.children.put(child.path[0], child):
            self.children = _grown(self.children)


class RadixTree:
    """Keys of any length with a value each; equal keys share a node."""

    def __init__(self):
        self.root, self.size = _Node(b""), 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        self.size += len(key) + 64
        while True:
            if at == len(key):
                node.ends.append(value)
                return
            child = node.children.get(key[at])
            if child is None:
                child = _Node(key[at:])
                node.put(child)
                child.ends.append(value)
                return
            path = child.path
            if key.startswith(path, at):
                node, at = child, at + len(path)
                continue
            same = next((i for i in range(min(len(path), len(key) - at)) if path[i] != key[at + i]), min(len(path), len(key) - at))
            upper = _Node(path[:same])  # the compressed bytes part here
            child.path = path[same:]
            upper.put(child)
            node.put(upper)
            node, at = upper, at + same

    def nodes(self) -> Iterator[tuple[_Node, int, int]]:
        """(node, byte depth, number of the node above) from the top down; -1 above the root."""
        stack, n = [(self.root, 0, -1)], 0
        while stack:
            node, depth, up = stack.pop()
            yield node, depth + len(node.path), up
            stack += [(child, depth + len(node.path), n) for _, child in node.children.items()]
            n += 1


_TURN = "conv bigint, place bigint, turn binary, bytes bigint, weight bigint, mark bigint"
_PART = "kind int, pid binary, up binary, depth bigint, conv bigint, n bigint, weight bigint, mark bigint, before bigint"
_NODES, _ENDS = 0, 1


def _given(tree: RadixTree) -> Iterator[pa.RecordBatch]:
    """Trie nodes of a tree with the number, least id and sums of the conversations below, and the ends.

    A value is (conversation, weight, mark, bytes of the text up to each turn).
    """
    steps = list(tree.nodes())
    n, least, weight, mark = (np.zeros(len(steps), np.int64) for _ in range(4))
    least += np.iinfo(np.int64).max
    below: list = [None] * len(steps)  # a value whose key leads through the step
    for i in range(len(steps) - 1, -1, -1):
        node, _, up = steps[i]
        for value in node.ends:
            n[i], least[i], weight[i], mark[i] = n[i] + 1, min(least[i], value[0]), weight[i] + value[1], mark[i] + value[2]
            below[i] = value
        if up >= 0:
            n[up], least[up], weight[up], mark[up] = n[up] + n[i], min(least[up], least[i]), weight[up] + weight[i], mark[up] + mark[i]
            below[up] = below[i]
    rows, state = [], [(b"", b"")] * len(steps)  # per step: digest of its whole turns, and the bytes since
    for i, (node, depth, up) in enumerate(steps):
        if not n[i]:
            continue
        digest, rest = state[up] if up >= 0 else (_ROOT, b"")
        sums = (int(least[i]), int(n[i]), int(weight[i]), int(mark[i]))
        if up < 0:
            rows.append((_NODES, digest, None, 0, *sums, 0))
        rest += node.path
        turn = (depth - len(rest)) // TURN_BYTES
        for at in range(TURN_BYTES, len(rest) + 1, TURN_BYTES):
            above, digest = digest, hashlib.blake2b(digest + rest[at - TURN_BYTES:at], digest_size=TURN_BYTES).digest()
            turn += 1
            rows.append((_NODES, digest, above, turn, *sums, below[i][3][turn]))
            if len(rows) >= BATCH_ROWS:
                yield _rows(rows)
                rows = []
        state[i] = (digest, rest[len(rest) // TURN_BYTES * TURN_BYTES:])
        rows += [(_ENDS, digest, None, turn, value[0], 1, 0, 0, 0) for value in node.ends]
        if len(rows) >= BATCH_ROWS:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in _PART.split(", ")]
    types = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)], [f for f, _ in fields])


def _trees(tree_bytes: int):
    """Turns in the order of (conversation, place) to the parts of the trie that each tree gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, conv, key, sums, value = RadixTree(), None, [], [0], None
        for batch in batches:
            convs, places, turns, sizes, weights, marks = (c.to_pylist() for c in batch.columns)
            for c, p, t, b, w, m in zip(convs, places, turns, sizes, weights, marks):
                if c != conv:
                    if conv is not None:
                        tree.insert(b"".join(key), value)
                        if tree.size > tree_bytes:
                            yield from _given(tree)
                            tree = RadixTree()
                    conv, key, sums = c, [], [0]
                    value = (c, w, m, sums)
                if p:  # place 0 is the conversation itself, which may have no turn
                    key.append(t)
                    sums.append(sums[-1] + b)
        if conv is not None:
            tree.insert(b"".join(key), value)
            yield from _given(tree)

    return run


def _through_trees(turns: DataFrame, tree_bytes: int) -> DataFrame:
    dealt = turns.select(*(f.split()[0] for f in _TURN.split(", "))).repartition("conv").sortWithinPartitions("conv", "place")
    return cut_lineage(dealt.mapInArrow(_trees(tree_bytes), _PART))


def _ends(parts: DataFrame) -> DataFrame:
    """(pid, ends_sha256): the digest of the ascending ids of the conversations that end at a node.

    Ids are put in order over all tasks and joined in pieces; only the pieces of a node meet in one task,
    which reads them one after the other, as a digest of their sequence has to.
    """
    def pieces(batches):
        at, ids = None, []

        def piece():
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["pid", "first", "ids"])

        for batch in batches:
            for pid, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (pid != at or len(ids) >= ENDS_PER_PIECE):
                    yield piece()
                    ids = []
                at = pid
                ids.append(conv)
        if ids:
            yield piece()

    def digests(batches):
        at, state = None, None
        for batch in batches:
            done = []
            for pid, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if pid != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = pid, hashlib.sha256()
                    state.update(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digest_rows(done)
        if at is not None:
            yield _digest_rows([(at, state.hexdigest())])

    ends = parts.filter(f"kind = {_ENDS}").select("pid", "conv")
    joined = ends.repartitionByRange("pid", "conv").sortWithinPartitions("pid", "conv").mapInArrow(pieces, "pid binary, first bigint, ids string")
    return (joined.repartition("pid").sortWithinPartitions("pid", "first")
            .mapInArrow(digests, "pid binary, ends_sha256 string"))


def _digest_rows(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      ["pid", "ends_sha256"])


def turn_rows(turns: DataFrame, conv: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, turn, bytes): turns numbered from 1, with the turn's id and the text's UTF-8 bytes.

    Order is by ``order`` (null first), then by the first 64 characters of the role and of the text, each
    with its digest, so that repeated turn numbers have one order and no text is sorted as a whole.  A
    null role or text is empty.  Repeated rows are turns of their own.  Rows without a conversation are
    no part of one.  Other columns are not read.
    """
    said = turns.select(F.col(quoted(conv)).cast("bigint").alias("conv"), F.col(quoted(order)).alias("at"),
                        F.coalesce(F.col(quoted(role)), F.lit("")).alias("role"),
                        F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).filter("conv IS NOT NULL")
    # The role's length keeps "a" + "bc" and "ab" + "c" apart.
    hashed = said.select("conv", "at", F.md5("role").alias("r"), F.substring("role", 1, 64).alias("role"), F.substring("text", 1, 64).alias("text"),
                         F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("turn"),
                         F.octet_length("text").cast("bigint").alias("bytes"))
    by = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "role", "r", "text", "turn")
    return hashed.withColumn("place", F.row_number().over(by).cast("bigint")).select("conv", "place", "turn", "bytes")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """One row per distinct prefix of the conversations in ``turns`` (conv, place from 1, turn, bytes).

    ``convs`` (conv) names all conversations, those without turns included (default: those of
    ``turns``).  Columns: conv_id (smallest conversation that begins with the prefix), depth in turns,
    parent_conv_id (of the prefix without its last turn; null for the root), n_convs, n_children,
    n_leaves (prefixes below or equal that no conversation continues), saved_tokens (over these
    prefixes, (n_convs - 1) times the bytes of the last text) and ends_sha256 (of the ascending ids of
    the conversations that end here).  (conv_id, depth) is unique.  No conversations give no rows.
    """
    heads = (turns.select("conv") if convs is None else convs.select("conv")).distinct()
    heads = heads.select("conv", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("bigint").alias("bytes"))
    turns = cut_lineage(heads.unionByName(turns.select("conv", "place", "turn", "bytes")))
    totals = turns.groupBy("conv").agg(F.sum("bytes").alias("total"))
    one = F.lit(1).cast("bigint")
    parts = _through_trees(turns.join(totals, "conv").select("conv", "place", "turn", "bytes", F.col("total").alias("weight"), one.alias("mark")),
                           tree_bytes)
    # Stored, so that the join with the node above deals both sides anew and can split a node with many children.
    merged = cut_lineage(parts.filter(f"kind = {_NODES}").groupBy("pid").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n_convs"),
        F.sum("weight").alias("weight"), F.first("before").alias("before")))
    children = parts.filter(f"kind = {_NODES} AND up IS NOT NULL").groupBy("up").agg(F.countDistinct("pid").alias("n_children"))
    counted = merged.join(children.withColumnRenamed("up", "pid"), "pid", "left").na.fill(0, ["n_children"])
    above = merged.select(F.col("pid").alias("up"), F.col("conv").alias("parent_conv_id"), F.col("before").alias("above"))
    nodes = cut_lineage(counted.join(above, "up", "left").na.fill(0, ["above"]))
    # The chain of a conversation: the nodes from the first that belongs to it down to its last turn.
    # ``above`` holds the bytes of the turns before a node's last one.
    chains = cut_lineage(nodes.groupBy("conv").agg(F.min("above").alias("chain_above"), F.max_by("n_children", "depth").alias("go_on"))
                         .join(totals, "conv").withColumn("leaf", (F.col("go_on") == 0).cast("bigint")))
    owned = turns.join(chains.select("conv", (F.col("total") - F.col("chain_above")).alias("weight"), F.col("leaf").alias("mark")), "conv")
    below = _through_trees(owned, tree_bytes).filter(f"kind = {_NODES}").groupBy("pid").agg(
        F.sum("weight").alias("chain_bytes"), F.sum("mark").alias("n_leaves"))
    # A node's subtree is the chains that begin in it and the rest of its own chain.
    found = nodes.join(below, "pid").join(chains.select("conv", "chain_above"), "conv").join(_ends(parts), "pid", "left")
    distinct_bytes = F.col("chain_bytes") - (F.col("above") - F.col("chain_above"))
    all_bytes = F.col("weight") - F.col("n_convs") * F.col("above")
    return found.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                        (all_bytes - distinct_bytes).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def rebuilt_turns(turns: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilding: (conv, place, turn, bytes) and (conv) of all conversations, turnless ones too.

    Conversation c begins with the first h turns of conversation c - c % 5 (truncated division) and goes on
    with its own turns after its first h, where h is crc32 of c's decimal text, modulo 9.
    """
    rows = cut_lineage(turn_rows(turns, **columns))
    convs = cut_lineage(rows.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % 5).alias("base"), (F.crc32(F.col("conv").cast("string")) % 9).alias("h")))
    own = rows.join(convs, "conv").filter("place > h").select("conv", F.col("place") + 8, "turn", "bytes")
    first = rows.filter("place <= 8").withColumnRenamed("conv", "base").join(convs, "base").filter("place <= h")
    both = first.select("conv", "place", "turn", "bytes").unionAll(own)
    place = F.row_number().over(Window.partitionBy("conv").orderBy("place")).cast("bigint")
    return both.withColumn("place", place), convs.select("conv")
