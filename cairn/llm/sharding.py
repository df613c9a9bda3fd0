"""Sharding through fixed virtual slots and a versioned slot-to-shard map (operator 2).

Records hash into thousands of slots that never change.  Only the small map from slots to shards is
edited: when bytes are out of balance, when shards are added, or when a slot is so large that its
lanes (a fixed second division, used for nothing else) have to be dealt to several shards.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.words import neutral_names, quoted

SLOTS, LANES = 4096, 16
_MAP_SCHEMA = "version bigint, slot int, lane int, shard int, bytes bigint, rows bigint, first bigint"


@dataclass(frozen=True)
class Entry:
    """A unit of the map: a slot, or one lane of a split slot (``lane`` is null for a whole slot)."""

    slot: int
    lane: int | None
    shard: int
    bytes: int = 0
    rows: int = 0


@dataclass(frozen=True)
class ShardMap:
    version: int
    shards: int
    entries: tuple[Entry, ...]

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for e in self.entries:
            out[e.shard] += e.bytes
        return out


def first_map(shards: int, slots: int = SLOTS) -> ShardMap:
    """Version 1: the slots in turn, without regard to sizes."""
    return ShardMap(1, shards, tuple(Entry(s, None, s % shards) for s in range(slots)))


def _spread_of(total: int, shards: int) -> int:
    """A slot above this size is split: a sixteenth of a shard is too coarse to balance."""
    return max(1, total // (shards * 16))


def rebalance(old: ShardMap, sizes: dict[tuple[int, int], tuple[int, int]], shards: int | None = None) -> ShardMap:
    """The next version: as few moved entries as balance needs.

    ``sizes`` has (bytes, rows) by (slot, lane), at most slots x lanes entries.  Slots larger than a
    sixteenth of a shard become one entry for each lane.  Entries then move from the fullest to the
    emptiest shard, each time the one that best halves the gap, while the gap shrinks.
    """
    shards = shards or old.shards
    total = sum(b for b, _ in sizes.values())
    by_slot: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    for (slot, _), (size, rows) in sizes.items():
        by_slot[slot][0] += size
        by_slot[slot][1] += rows
    entries: list[Entry] = []
    for e in old.entries:
        if e.lane is not None:
            size, rows = sizes.get((e.slot, e.lane), (0, 0))
            entries.append(replace(e, bytes=size, rows=rows))
        elif by_slot[e.slot][0] > _spread_of(total, shards):
            entries += [Entry(e.slot, lane, e.shard, *sizes.get((e.slot, lane), (0, 0))) for lane in range(LANES)]
        else:
            entries.append(replace(e, bytes=by_slot[e.slot][0], rows=by_slot[e.slot][1]))
    loads, held = [0] * shards, [[] for _ in range(shards)]
    for k, e in enumerate(entries):
        loads[e.shard] += e.bytes
        if e.bytes:
            held[e.shard].append(k)
    while True:
        full, empty = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        best = min(held[full], key=lambda k: (abs(gap - 2 * entries[k].bytes), k), default=None)
        if best is None or abs(gap - 2 * entries[best].bytes) >= gap:
            break
        moved = entries[best]
        held[full].remove(best)
        held[empty].append(best)
        loads[full] -= moved.bytes
        loads[empty] += moved.bytes
        entries[best] = replace(moved, shard=empty)
    return ShardMap(old.version + 1, shards, tuple(entries))


def map_table(spark: SparkSession, shard_map: ShardMap) -> DataFrame:
    """One row per entry; ``first`` is where the entry's rows begin within its shard."""
    taken, rows = [0] * shard_map.shards, []
    for e in shard_map.entries:
        rows.append((shard_map.version, e.slot, e.lane, e.shard, e.bytes, e.rows, taken[e.shard]))
        taken[e.shard] += e.rows
    return spark.createDataFrame(rows, _MAP_SCHEMA)


def save_map(spark: SparkSession, shard_map: ShardMap, folder: str) -> None:
    """One folder for each version; a version that is there is never changed."""
    map_table(spark, shard_map).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/version={shard_map.version}")


def load_map(spark: SparkSession, folder: str, version: int) -> ShardMap:
    rows = spark.read.schema(_MAP_SCHEMA).parquet(f"{folder}/version={version}").collect()
    entries = tuple(Entry(r.slot, r.lane, r.shard, r.bytes, r.rows)
                    for r in sorted(rows, key=lambda r: (r.slot, -1 if r.lane is None else r.lane)))
    return ShardMap(version, 1 + max(e.shard for e in entries), entries)


def with_slots(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Columns ``__slot`` (hash of key and text), ``__lane``, ``__size`` and ``__crc``.

    The lane of a row follows its place in the input's files, as equal rows have no other difference;
    the input must therefore be a stored table (or a checkpoint), which a rerun reads alike.
    """
    crc = F.crc32(F.coalesce(F.col(quoted(text)), F.lit("")))
    hashed = F.xxhash64(F.col(quoted(key)).cast("string"), F.col(quoted(text)))
    return docs.withColumns({
        "__slot": F.pmod(hashed, F.lit(slots)).cast("int"),
        "__lane": F.pmod(F.monotonically_increasing_id(), F.lit(LANES)).cast("int"),
        "__size": F.coalesce(F.octet_length(F.col(quoted(text))), F.lit(0)).cast("bigint") + 1,
        "__crc": crc.cast("bigint"),
    })


def slot_sizes(slotted: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(bytes, rows) by (slot, lane): at most slots x lanes rows, whatever the input's size."""
    rows = slotted.groupBy("__slot", "__lane").agg(F.sum("__size").alias("b"), F.count(F.lit(1)).alias("n")).collect()
    return {(r["__slot"], r["__lane"]): (r.b, r.n) for r in rows}


def _with_entries(slotted: DataFrame, shard_map: ShardMap) -> DataFrame:
    """Shard and first place of each row's entry; the map has at most slots x lanes rows."""
    entries = map_table(slotted.sparkSession, shard_map)
    whole = entries.filter("lane IS NULL").select(
        F.col("slot").alias("__slot"), F.col("shard").alias("__shard"), F.col("first").alias("__first"))
    parts = entries.filter("lane IS NOT NULL").select(
        F.col("slot").alias("__slot"), F.col("lane").alias("__lane"),
        F.col("shard").alias("__lane_shard"), F.col("first").alias("__lane_first"))
    out = slotted.join(F.broadcast(whole), "__slot", "left").join(F.broadcast(parts), ["__slot", "__lane"], "left")
    split: Column = F.col("__lane_shard").isNotNull()
    return out.withColumns({
        "__unit": F.when(split, F.col("__lane")).otherwise(F.lit(-1)),
        "__shard": F.coalesce("__lane_shard", "__shard"),
        "__first": F.coalesce("__lane_first", "__first"),
    }).drop("__lane_shard", "__lane_first")


def balanced_map(slotted: DataFrame, shards: int, slots: int = SLOTS) -> ShardMap:
    """Version 2 of the map: version 1 edited until the shards have nearly equal bytes."""
    return rebalance(first_map(shards, slots), slot_sizes(slotted))


def assign_shards(docs: DataFrame, shard_map: ShardMap, key: str = "doc_id", text: str = "text",
                  slots: int = SLOTS) -> DataFrame:
    """The documents with ``shard`` and ``virtual_slot``; no row is moved.

    A null key or text is a value like any other; equal rows get the same slot, which is split by
    lanes when it is large.  Columns with these two names are replaced.
    """
    plain, names = neutral_names(docs)
    kept = [F.col(names[c]).alias(c) for c in docs.columns if c not in ("shard", "virtual_slot")]
    placed = _with_entries(with_slots(plain, names[key], names[text], slots), shard_map)
    return placed.select(*kept, F.col("__shard").alias("shard"), F.col("__slot").alias("virtual_slot"))


def placed_rows(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Key, size, checksum, shard and gapless place within the shard of every row (law ``bytes``).

    The text stays where it is; narrow rows are shuffled by map entry and numbered there by key,
    size and checksum, starting at the entry's first place.  An empty table gives an empty table.
    """
    slotted = with_slots(docs, key, text, slots).select(quoted(key), "__slot", "__lane", "__size", "__crc")
    placed = _with_entries(slotted, balanced_map(slotted, shards, slots))
    within = Window.partitionBy("__slot", "__unit").orderBy(quoted(key), "__size", "__crc")
    return placed.select(
        F.col(quoted(key)), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("__shard").alias("shard"), (F.col("__first") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col("__slot").alias("virtual_slot"))
