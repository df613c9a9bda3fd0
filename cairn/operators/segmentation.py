"""Word segmentation of scripts without spaces by a lattice.

The words are learned from the texts themselves.  Every run of 1 to ``max_chars`` characters is counted with
its left and right neighbours; a run is a word if it is frequent, holds together better than its parts
(cohesion), and stands in many surroundings (branching entropy on both sides).  Words and single characters
get a cost by frequency, and the cheapest path through each run's lattice of words is its segmentation.

All counting is on distinct runs, so a phrase that a third of all texts repeat is one row.  Costs are whole
numbers, so that equal paths are equal on every cluster; among them the one whose last word is longest wins.

Texts and runs are looked up in blocks: a block asks once for each of its distinct runs (or words), and the
answers come to the block, so what is shuffled follows the distinct runs of a block and not its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import cut_lineage


@dataclass(frozen=True)
class SegmentRules:
    """``run`` is what is segmented, ``other`` what is a token as it stands; both match lower-cased text."""

    run: str = "\\p{IsHan}+"
    other: str = "[\\p{L}\\p{N}&&[^\\p{IsHan}]]+"
    max_chars: int = 4
    min_count: int = 5
    min_cohesion: float = 1.0
    min_entropy: float = 0.8
    #: Whole units of cost for one unit of log probability.
    scale: int = 1_000_000
    #: Texts, or distinct runs, of one block; and the bytes of its texts.
    rows_per_task: int = 100_000
    bytes_per_task: int = 32_000_000


DEFAULT = SegmentRules()
#: Items whose words are put in place by one set of array operations.
ITEMS_AT_ONCE = 1_000_000


def _items(text: Column, rules: SegmentRules) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({rules.run}|{rules.other})"), 1)


def run_counts(texts: DataFrame, text: str, rules: SegmentRules = DEFAULT) -> DataFrame:
    """(run, n): distinct runs and how often each occurs; combined before the shuffle."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({rules.run})"), 1)
    return texts.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def _substrings(longest: int) -> Column:
    """Every substring of a run of up to ``longest`` characters, one item a place."""
    def of_length(size: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("run") - size + 1), lambda p: F.substr("run", p, size))

    return F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("run"))), of_length))


def _entropies(whole: DataFrame, grams: DataFrame, side: str) -> DataFrame:
    """(gram, entropy): ln(total) - sum(n ln n) / total over the neighbours on one side.

    A run with one neighbour is a run of one character more; what these do not count stands at the edge of a run.
    """
    start = F.lit(2 if side == "left" else 1)
    longer = grams.filter(F.length("gram") > 2).select(F.substr("gram", start, F.length("gram") - 1).alias("gram"), "n")
    inside = longer.join(whole, "gram", "left_semi").groupBy("gram").agg(
        F.sum("n").alias("inside"), F.sum(F.col("n") * F.log("n")).alias("logs"))
    edge = F.col("n") - F.coalesce("inside", F.lit(0))
    logs = F.coalesce("logs", F.lit(0.0)) + F.when(edge > 0, edge * F.log(edge)).otherwise(0.0)
    return whole.join(inside, "gram", "left").select("gram", (F.log("n") - logs / F.col("n")).alias(f"{side}_entropy"))


def segment_words(runs: DataFrame, rules: SegmentRules = DEFAULT) -> DataFrame:
    """(word, n, cost): single characters and the runs that pass all three tests.

    ``cost`` is -ln(n / total of all words) in ``scale`` units.  No runs give no words.
    """
    grams = cut_lineage(runs.select("n", F.explode(_substrings(rules.max_chars + 1)).alias("gram")).groupBy("gram").agg(F.sum("n").alias("n")))
    counts = grams.filter(F.length("gram") <= rules.max_chars)
    chars = counts.filter(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("chars"))
    frequent = counts.filter((F.length("gram") > 1) & (F.col("n") >= rules.min_count))
    # The weakest cut of a run: how much more often it occurs than its two parts by chance.
    cuts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda k: F.struct(
        F.substr("gram", F.lit(1), k).alias("head"), F.substr("gram", k + 1, F.length("gram") - k).alias("tail")))
    parts = frequent.withColumn("cut", F.explode(cuts)).select("gram", "n", "cut.head", "cut.tail")
    for part in ("head", "tail"):
        parts = parts.join(counts.select(F.col("gram").alias(part), F.col("n").alias(f"{part}_n")), part)
    # The number of characters is one row.
    whole = cut_lineage(parts.join(F.broadcast(chars)).groupBy("gram", "n").agg(F.min(F.log(
        F.col("n") * F.col("chars") / (F.col("head_n") * F.col("tail_n")))).alias("cohesion"))
        .filter(F.col("cohesion") >= rules.min_cohesion).drop("cohesion"))
    open_ = reduce(lambda a, b: a.join(b, "gram"), [
        _entropies(whole, grams, side).filter(F.col(f"{side}_entropy") >= rules.min_entropy) for side in ("left", "right")])
    words = cut_lineage(counts.filter(F.length("gram") == 1).unionByName(whole.join(open_, "gram", "left_semi")))
    total = words.agg(F.sum("n").alias("total"))
    cost = F.round(F.log(F.col("total") / F.col("n")) * rules.scale).cast("bigint")
    return words.join(F.broadcast(total)).select(F.col("gram").alias("word"), "n", cost.alias("cost"))


def _block(rows: DataFrame, key: str, least: int) -> Column:
    """A block that follows from the key alone, so a re-run task puts every row into the same one again."""
    blocks = max(least, rows.sparkSession.sparkContext.defaultParallelism)
    return F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block")


def _map_answered(rows: DataFrame, answers: DataFrame, ready: Callable, job: Callable,
                  schema: T.StructType | str, derived: dict[str, Column] | None = None) -> DataFrame:
    """``job(ready(answers of a block), rows of the block)`` for both tables' column ``block``.

    ``derived`` columns are added after the shuffle.  The answers of a block come before its rows; a task holds the answers of one block and one batch of rows.
    """
    both = answers.withColumn("is_row", F.lit(False)).unionByName(rows.withColumn("is_row", F.lit(True)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, state = None, [], None
        for batch in batches:
            blocks, is_row = batch.column("block").to_numpy(), batch.column("is_row").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero((np.diff(blocks) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1).tolist(), len(blocks)]
            for at, end in zip(bounds, bounds[1:]):
                if at == end:
                    continue
                part = batch.slice(at, end - at)
                if blocks[at] != block:
                    block, held, state = blocks[at], [], None
                if not is_row[at]:
                    held.append(part)
                    continue
                if state is None:
                    state, held = ready(pa.Table.from_batches(held, batch.schema).combine_chunks()), []
                yield from job(state, part)

    ordered = both.repartition("block").sortWithinPartitions("block", "is_row")
    return ordered.withColumns(derived or {}).mapInArrow(run, schema)


def cheapest_path(run: str, costs: dict[str, int], unknown: int, max_chars: int) -> list[str]:
    """The words of one run: at every character the cheapest (cost, -size) of the words that end with it."""
    best = [(0, 0)]
    for end in range(1, len(run) + 1):
        ways = []
        for size in range(1, min(max_chars, end) + 1):
            cost = costs.get(run[end - size:end], unknown if size == 1 else None)
            if cost is not None:
                ways.append((best[end - size][0] + cost, -size))
        best.append(min(ways))
    words, end = [], len(run)
    while end:
        size = -best[end][1]
        words.append(run[end - size:end])
        end -= size
    return words[::-1]


def segmented_runs(runs: DataFrame, words: DataFrame, rules: SegmentRules = DEFAULT) -> DataFrame:
    """(run, words): the cheapest path through the words of each distinct run.

    Characters that are no word cost more than the rarest one.  A block of runs asks once for each of its
    distinct substrings and gets those that are words.
    """
    unknown = words.agg(F.coalesce(F.max("cost"), F.lit(0)) + rules.scale).first()[0]
    max_chars = rules.max_chars
    placed = runs.select(_block(runs, "run", ceil(runs.count() / rules.rows_per_task)), "run")
    asked = placed.repartition("block").select("block", F.explode(_substrings(max_chars)).alias("word")).distinct()
    answers = asked.join(words.select("word", "cost"), "word")

    def ready(known: pa.Table) -> dict[str, int]:
        return dict(zip(known.column("word").to_pylist(), known.column("cost").to_pylist()))

    def job(costs: dict[str, int], part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [cheapest_path(r, costs, unknown, max_chars) for r in part.column("run").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("run"), pa.array(found, pa.list_(pa.string()))], ["run", "words"])

    return _map_answered(placed, answers, ready, job, "run string, words array<string>")


def _tokens(answers: pa.Table, items: pa.ListArray) -> pa.ListArray:
    """``items`` with every item that has an answer replaced by its words."""
    at = pc.index_in(items.flatten(), answers.column("run"))
    unknown = at.is_null().to_numpy(zero_copy_only=False)
    at = at.fill_null(0).to_numpy()
    words = answers.column("words").combine_chunks() if len(answers) else pa.array([[]], items.type)
    pool = pa.concat_arrays([words.flatten(), items.flatten()])
    bounds = np.append(0, np.cumsum(pc.list_value_length(words).to_numpy()))
    first = np.where(unknown, bounds[-1] + np.arange(len(at)), bounds[at])
    sizes = np.where(unknown, 1, bounds[at + 1] - bounds[at])
    ends = np.append(0, np.cumsum(sizes))
    order = np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])
    rows = np.append(0, np.cumsum(pc.list_value_length(items).to_numpy()))
    return pa.ListArray.from_arrays(pa.array(ends[rows], pa.int32()), pool.take(pa.array(order, pa.int64())))


def with_tokens(texts: DataFrame, key: str, text: str, segments: DataFrame, rules: SegmentRules = DEFAULT) -> DataFrame:
    """``texts`` with ``tokens``: its runs segmented, its other words as they stand, in the text's order.

    ``key`` must be unique.  Null and blank texts have no tokens.  A block asks once for each of its distinct
    items, so a run that very many texts share is no hot key.
    """
    rows, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    block = _block(texts, key, max(ceil(rows / rules.rows_per_task), ceil(size / rules.bytes_per_task)))
    # Texts are dealt by block first: the items of a block are then distinct where they are found.
    dealt = texts.select(block, F.col(text).alias("text")).repartition("block")
    asked = dealt.select("block", F.explode(_items(F.col("text"), rules)).alias("run")).distinct()

    def job(answers: pa.Table, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        items = pc.sum(pc.list_value_length(part.column("items"))).as_py()
        rows = max(1, len(part) * ITEMS_AT_ONCE // max(1, items))
        for at in range(0, len(part), rows):
            some = part.slice(at, rows)
            yield pa.RecordBatch.from_arrays([some.column("row"), _tokens(answers, some.column("items"))], ["row", "tokens"])

    schema = T.StructType([T.StructField("row", texts.schema), T.StructField("tokens", T.ArrayType(T.StringType()))])
    return _map_answered(texts.select(block, F.struct("*").alias("row")), asked.join(segments, "run"), lambda known: known, job, schema,
                         {"items": _items(F.col("row")[text], rules)}).select("row.*", "tokens")


def segment(texts: DataFrame, key: str, text: str, rules: SegmentRules = DEFAULT) -> DataFrame:
    """``texts`` with the tokens of a model that is learned from these texts."""
    runs = cut_lineage(run_counts(texts, text, rules))
    words = cut_lineage(segment_words(runs, rules))
    return with_tokens(texts, key, text, cut_lineage(segmented_runs(runs, words, rules)), rules)
