"""Mixing sources to target weights by a low-discrepancy schedule (operator 5), DataFrame operations only.

The schedule is a row of slots.  Slot t has the van der Corput point of t, which the cumulative
weights map to a source; the rank of a slot among its source's slots says which block of the source
it takes.  Blocks are equal runs of tokens of the source's shuffled documents, read again from the
start when the source is used up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.words import given_names, neutral_names, quoted
from cairn.session import cut_lineage

BLANKS = "\t\n\x0b\f\r "
#: The schedule has about so many slots whatever the input's size; blocks grow with the input instead.
SCHEDULE_BITS = 16
#: A source's documents are put in order in independent buckets, by so many hexadecimal digits.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``: each, with the blanks after it, becomes one letter; no list of words is made."""
    letters = F.regexp_replace(F.btrim(text, F.lit(BLANKS)), r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", "w")
    return F.coalesce(F.length(letters), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Sources with weight and target from (source, size): one row for each source.

    Weights repeat over the sources in code point order, null last.  Targets share the whole size by
    weight; a target stops at ``max_epochs`` times the source's size and the rest is shared again.
    The capped sources are those with the least size for their weight, so one pass over the sources
    in that order finds them all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_need = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(from_here)
    ranked = (sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
              .withColumn("place", F.row_number().over(by_need)).withColumn("rate", rate)
              # The first source below its cap sets the rate of all after it.
              .withColumn("free", F.when(F.col("rate") * F.col("weight") < F.col("cap"), F.col("place")))
              .withColumn("first_free", F.min("free").over(everything))
              .withColumn("shared", F.max(F.when(F.col("place") == F.col("first_free"), F.col("rate"))).over(everything)))
    return ranked.select("source", "source_size", "weight",
                         F.when(F.col("place") >= F.col("first_free"), F.col("shared") * F.col("weight"))
                         .otherwise(F.col("cap").cast("double")).alias("target"))


def schedule(targets: DataFrame, bits: int = SCHEDULE_BITS) -> DataFrame:
    """(source, time, rank, begin, end): the slots of every source and the stream words each takes.

    A source gets ceil(target / block) cells of a grid of 2^k; the van der Corput points of
    0 .. 2^k - 1 meet every cell once, so each prefix of the schedule is near the weights and the
    whole meets them.  Points beyond the last source's cells are no slots.  The slot of rank r takes
    the block [r x block, (r + 1) x block) of the source's documents repeated end to end, the last
    one up to the target.  There are at most 2^bits slots and one for each source.
    """
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    block = max(1, -(-total // (1 << bits)))
    wanted = targets.withColumn("words", F.round("target").cast("bigint"))
    wanted = wanted.withColumn("slots", F.ceil(F.col("words") / block).cast("bigint"))
    ordered = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    cells = (wanted.withColumn("first_cell", F.coalesce(F.sum("slots").over(ordered), F.lit(0)))
             .filter("slots > 0").withColumn("cell", F.explode(F.expr("sequence(first_cell, first_cell + slots - 1)"))))
    count = wanted.agg(F.sum("slots")).first()[0] or 0
    digits = max(1, (max(1, count) - 1).bit_length())
    # The point of a time is its binary digits reversed, so a cell's time is the cell's digits reversed.
    time = F.conv(F.reverse(F.lpad(F.bin("cell"), digits, "0")), 2, 10).cast("bigint")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("time")).cast("bigint") - 1
    begin = F.col("rank") * F.lit(block)
    return (cells.withColumn("time", time).withColumn("rank", rank)
            .select("source", "time", "rank", begin.alias("begin"),
                    F.least(begin + F.lit(block), F.col("words")).alias("end"), F.lit(block).cast("bigint").alias("block")))


def _units(docs: DataFrame, key: str, text: str, source: str, row_hash: Sequence[str]) -> DataFrame:
    """(source, key, size, row_hash, copies): equal rows are one unit, counted before the shuffle."""
    narrow = docs.select(F.col(quoted(source)).alias("source"), F.col(quoted(key)).alias("key"),
                         word_count(F.col(quoted(text))).alias("size"), F.xxhash64(*map(quoted, row_hash)).alias("row_hash"))
    return narrow.groupBy("source", "key", "size", "row_hash").agg(F.count(F.lit(1)).alias("copies"))


def _join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join in which a null key meets a null key; the left side's keys stay."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in on})
    return left.join(right, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]), how).drop(
        *[f"__{c}" for c in on])


def shuffled_streams(units: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Units with ``first``, their place in the source's shuffled stream of words, and the targets.

    The order is that of a digest.  Its leading digits make buckets, whose sums are added up per
    source (at most 16^BUCKET_DIGITS rows); places within a bucket need only the bucket's rows.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "source", F.col("key").cast("string"), F.col("size").cast("string")))
    words = F.col("size") * F.col("copies")
    placed = units.withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (placed.groupBy("source", "bucket").agg(F.sum(words).alias("bucket_words"))
               .withColumn("bucket_first", F.coalesce(F.sum("bucket_words").over(earlier), F.lit(0))))
    within = Window.partitionBy("source", "bucket").orderBy("order", "row_hash").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumn("in_bucket", F.coalesce(F.sum(words).over(within), F.lit(0)))
    return _join(_join(running, buckets, ["source", "bucket"]), targets, ["source"]).select(
        "source", "key", "size", "row_hash", "copies", "source_size", "target",
        (F.col("bucket_first") + F.col("in_bucket")).alias("first"))


def join_blocks(rows: DataFrame, slots: DataFrame, words: Column, max_epochs: int) -> DataFrame:
    """``taken`` for each row: its words in the blocks that the slots of its source take.

    A row lies at ``first`` in every epoch of its source's stream; each of its ranges meets the few
    slots whose blocks it touches by (source, rank).
    """
    block = slots.agg(F.max("block")).first()[0] or 1
    begin = F.col("first") + F.col("epoch") * F.col("source_size")
    ranges = (rows.withColumn("words", words).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
              .withColumn("from", begin).withColumn("to", begin + F.col("words")))
    touched = F.when(F.col("words") > 0, F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block)))
    ranges = ranges.withColumn("rank", F.explode_outer(touched))
    met = _join(ranges, slots.select("source", "rank", "begin", "end"), ["source", "rank"], "left")
    part = F.greatest(F.lit(0), F.least("to", "end") - F.greatest("from", "begin"))
    return met.groupBy(*rows.columns).agg(F.coalesce(F.sum(F.when(F.col("end").isNotNull(), part)), F.lit(0)).alias("taken"))


def _plan(docs: DataFrame, weights: Sequence[int], max_epochs: int, seed: int, key: str, text: str, source: str,
          row_hash: Sequence[str], bits: int) -> tuple[DataFrame, DataFrame]:
    units = cut_lineage(_units(docs, key, text, source, row_hash))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    targets = cut_lineage(source_targets(sizes, weights, max_epochs))
    return shuffled_streams(units, targets, seed), cut_lineage(schedule(targets, bits))


def document_takes(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 5, key: str = "doc_id",
                   text: str = "text", source: str = "source", bits: int = SCHEDULE_BITS) -> DataFrame:
    """(key, source, size, source_size, target, taken): one row for each document.

    Null texts have size 0 and take nothing; a null source is one source, the last; equal rows follow
    each other in the stream.  With no words at all every target is 0; an empty table gives none.
    """
    units, slots = _plan(docs, weights, max_epochs, seed, key, text, source, [key, text], bits)
    # Copies in two steps, so that no array grows with a hot row.
    chunk = 4096
    rows = (units.withColumn("chunk", F.explode(F.expr(f"sequence(0, (copies - 1) div {chunk})")))
            .withColumn("copy", F.explode(F.expr(f"sequence(chunk * {chunk}, least(copies, (chunk + 1) * {chunk}) - 1)")))
            .withColumn("first", F.col("first") + F.col("copy") * F.col("size")))
    return join_blocks(rows, slots, F.col("size"), max_epochs).select("key", "source", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 5, key: str = "doc_id",
                  text: str = "text", source: str = "source", bits: int = SCHEDULE_BITS) -> DataFrame:
    """The mixture as documents: each as often as its taken words come nearest to whole copies.

    Equal rows share the words of their unit evenly; documents without words are not taken.  Columns
    stay as they are, whatever their names.
    """
    docs, names = neutral_names(docs)
    key, text, source, columns = names[key], names[text], names[source], docs.columns
    units, slots = _plan(docs, weights, max_epochs, seed, key, text, source, columns, bits)
    words = F.col("size") * F.col("copies")
    takes = join_blocks(units, slots, words, max_epochs)
    repeats = takes.select(F.col("row_hash").alias("__row"), F.col("key").alias("__key"), F.col("source").alias("__source"),
                           F.round(F.try_divide("taken", words)).cast("int").alias("__times")).filter("__times > 0")
    rows = docs.withColumn("__hash", F.xxhash64(*map(quoted, columns)))
    taken = (rows.join(repeats, (F.col("__hash") == F.col("__row")) & F.col(quoted(key)).eqNullSafe(F.col("__key"))
                          & F.col(quoted(source)).eqNullSafe(F.col("__source")))
             .withColumn("__copy", F.explode(F.expr("sequence(1, __times)"))))
    return given_names(taken, names)
