"""Words, hashes and n-grams of whole Arrow batches as numpy arrays, and the map step that uses them.

All word classes of this package are defined on ASCII, so they can be read off the UTF-8 bytes: every
byte of a longer code point counts as a word byte.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts are handled in slices of about so many bytes, or one document if that is longer.
SLICE_BYTES = 2 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: ``[^\x20\x09-\x0D]``
NOT_BLANK = (_BYTES != 32) & ((_BYTES < 9) | (_BYTES > 13))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, small letters and all that is not ASCII
ALNUM = ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Sums:
    """Prefix sums from which the hash of any byte range follows in constant time."""

    _powers = _powers(_BASE, 0), _powers(_BASE_INVERSE, 0)

    def __init__(self, data: np.ndarray):
        if len(Sums._powers[0]) < len(data) + 1:
            Sums._powers = _powers(_BASE, len(data) + 1), _powers(_BASE_INVERSE, len(data) + 1)
        self.up, self.down = Sums._powers
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODES[data] * self.up[:len(data)], out=self.sums[1:])

    def of_all(self, width: int) -> np.ndarray:
        """Hashes of the ``width`` bytes from each place that has so many left."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n] + _U(width)) | _U(1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of [start, end); never 0."""
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64)) | _U(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a slice: ``start`` and ``end`` in bytes, ``offsets`` of each document in words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        inside = word_bytes[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.offsets = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.offsets)

    def documents(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words, at each first word; only positions with n words left are valid."""
    size = max(0, len(hashes) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = (out + hashes[j:j + size]) * _BASE
    return mix(out) | _U(1)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces of about ``limit`` bytes of text."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


Compute = Callable[[np.ndarray, np.ndarray, pa.RecordBatch], Sequence[pa.Array]]


def map_texts(df: DataFrame, added: str | T.StructType, compute: Compute, text: str = "text",
              keep: Sequence[str] | None = None, reads: Sequence[str] = (), limit: int = SLICE_BYTES) -> DataFrame:
    """Columns ``keep`` (all, if not given) and those that ``compute`` derives from each slice.

    ``compute`` gets the bytes, the offsets and the slice with the text and the columns ``reads``; no
    row is moved.  A column of the input
    that has the name of an added one is replaced.
    """
    added = T.StructType.fromDDL(added) if isinstance(added, str) else added
    kept = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    schema = T.StructType([df.schema[c] for c in kept] + list(added))
    names = schema.names
    given = list(dict.fromkeys([*kept, text, *reads]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, limit):
                data, offsets = utf8(part.column(part.schema.get_field_index(text)))
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + list(compute(data, offsets, part)), names)

    return df.select(*given).mapInArrow(run, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def neutral_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows under names that clash with no added column, and the new name of each column."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def given_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns of ``neutral_names`` alone, under their own names again."""
    return df.select(*names.values()).toDF(*names)
