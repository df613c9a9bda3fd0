"""Blocks of consecutive rows, and questions to parts of a hash range that answer block by block."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def block_number(rows_log2: int) -> Column:
    """The same number for up to 2^rows_log2 consecutive rows of an input partition.

    It follows the rows' place in the input's files, so that a hot key has no block of its own; the
    input must be a stored table, which is read in the same order again.
    """
    return F.shiftright(F.monotonically_increasing_id(), rows_log2)


def table_of(rows: list[tuple], ddl: str) -> pa.Table:
    fields = [f.split() for f in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table({name: pa.array(c, _TYPES[t]) for (name, t), c in zip(fields, columns)})


def map_blocks(rows: DataFrame, ask: Callable[[pa.Table], pa.Table], ddl: str) -> DataFrame:
    """``ask`` applied to every block where it lies, without a shuffle; a task holds one block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            blocks = batch.column(batch.schema.get_field_index("block")).to_numpy()
            at = 0
            while at < len(blocks):
                end = at + int((blocks[at:] == blocks[at]).argmin()) if blocks[-1] != blocks[at] else len(blocks)
                part = batch.slice(at, end - at)
                if held and held[0].column(held[0].schema.get_field_index("block"))[0].as_py() != blocks[at]:
                    yield from ask(pa.Table.from_batches(held)).to_batches()
                    held = []
                held.append(part)
                at = end
        if held:
            yield from ask(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(run, ddl)
