"""Periodic runs of words by an online sparse diagonal table (operator 13).

The cell (word, lag) of the table holds how many words up to this one equal the word ``lag`` places
before.  A run of period q is a stretch of cells on the diagonal q, at least three periods long.  Words
are read in order; an earlier occurrence adds one to the match length of its lag, and a diagonal that
ends with sufficient length emits its run at once.

The table is kept sparse without losing a run.  Lags from B up to 2B are looked at with occurrences of 3B
words (B = 1, 2, 4, ...), as a run of such a lag repeats every 3B words of it but the last period.  Of
those occurrences only the latest counts: were there a nearer one in a run, the run would have a
smaller period.  So each word has at most one active lag for each B, and 3B words that occur once need
no cell at all.  A text of n words takes O(n log n) steps, whatever it repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairn.llm.words import NOT_BLANK, SLICE_BYTES, Sums, Words, map_texts

#: A run has at least so many words and so many periods.
MIN_WORDS, MIN_PERIODS = 6, 4

#: (values of a column, words of each document) -> for each document None, or the word to read at each place
Rewrite = Callable[[list, np.ndarray], list]


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and how often each key is there."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return name, count[name]


def _latest(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For each (key, place), in order of places, the lag to the key's latest earlier place; 0 if none."""
    by = np.argsort(keys, kind="stable")
    lag = np.zeros(len(keys), np.int64)
    same = keys[by[1:]] == keys[by[:-1]]
    lag[by[1:]] = np.where(same, places[by[1:]] - places[by[:-1]], 0)
    return lag


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``words`` are the word hashes of all documents, ``offsets`` the first word of each.
    """
    counts = np.diff(offsets)
    document = np.repeat(np.arange(len(counts)), counts)
    name, often = _names(words)
    # Names of the 2^k words from each place on; -1 where they are not there a second time.
    name = np.where(often > 1, name, -1)
    end, n, found, width = offsets[1:], len(words), [], 1
    while True:
        place = np.flatnonzero(name >= 0)
        place = place[place + 2 * width <= end[document[place]]]
        place = place[name[place + width] >= 0]
        if not len(place):
            break
        # Places in different documents may not share a name: the document leads the key.
        pair = name[place].astype(np.int64) * n + name[place + width]
        inner, often = _names(pair)
        own, often = _names(inner * len(counts) + document[place])
        double = np.full(n, -1, np.int64)
        double[place[often > 1]] = own[often > 1]
        at = np.flatnonzero(double >= 0)
        at = at[at + 3 * width <= end[document[at]]]
        at = at[name[at + 2 * width] >= 0]
        if len(at):
            lag = _latest(double[at] * n + name[at + 2 * width], at)
            active = (lag >= width) & (lag < 2 * width)
            found.append(_diagonals(at[active], lag[active], 3 * width))
        name, width = double, 2 * width
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    of = document[rows[:, 0]]
    rows = np.column_stack([of, rows[:, 0] - offsets[of], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _diagonals(place: np.ndarray, lag: np.ndarray, width: int) -> np.ndarray:
    """(start, length, period) of the diagonals that end with sufficient length.

    A cell goes on with its diagonal if the place before has the same lag; ``width`` words match from
    each place on.
    """
    if not len(place):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(place), bool)
    new[1:] = (np.diff(place) != 1) | (np.diff(lag) != 0)
    first = np.flatnonzero(new)
    cells = np.diff(np.append(first, len(place)))
    period = lag[first]
    length = cells + width - 1 + period
    enough = length >= np.maximum(MIN_WORDS, MIN_PERIODS * period)
    return np.column_stack([place[first] - period, length, period])[enough]


def _covered(runs: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words that any run contains after its first period."""
    change = np.zeros(offsets[-1] + 1, np.int64)
    start = offsets[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change)[:-1] > 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words one after the other, a space behind each, and the place of every word."""
    size = end - start + 1
    place = np.concatenate([[0], np.cumsum(size)])
    from_ = np.repeat(start - place[:-1], size) + np.arange(place[-1])
    out = np.append(data, np.uint8(32))[np.minimum(from_, len(data))]
    out[place[1:] - 1] = 32
    return out.tobytes(), place


RUNS = "runs array<struct<start: bigint, length: bigint, period: bigint>>"


def collapse_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rewrite: Rewrite | None = None,
                  reads: str | None = None, limit: int = SLICE_BYTES) -> DataFrame:
    """Columns ``keep`` (all, if not given), the runs of every text, and the text without their repeats.

    Adds ``runs`` (start in words from 0, length and smallest period, by start and then period), ``longest``
    (greatest length, then smallest start and period; null without a run), ``runs_sha256`` of the lines
    ``start,length,period``, ``collapsed`` (the words that no run contains after its first period, one
    space between them) and ``n_words``.  Words are maximal stretches without ASCII blanks, compared byte
    by byte.  A null, empty or blank text has no words and no runs and collapses to "".  Rows are handled
    each for itself: repeated rows and null keys do no harm, an empty table gives an empty table, and
    input columns of the added names are replaced.  ``rewrite`` may put other words of a document in
    place of its words before runs are looked for; it gets the values of the column ``reads``.

    A task holds a slice of about ``limit`` bytes, or one text if that is longer.
    """
    def compute(data, offsets, batch):
        words = Words(data, offsets, NOT_BLANK)
        source = np.arange(len(words.start))
        if rewrite is not None and len(batch):
            values = batch.column(batch.schema.get_field_index(reads)).to_pylist()
            for d, order in enumerate(rewrite(values, words.counts)):
                if order is not None:
                    source[words.offsets[d]:words.offsets[d + 1]] = words.offsets[d] + order
        start, end = words.start[source], words.end[source]
        runs = find_runs(Sums(data).of(words.start, words.end)[source], words.offsets)
        kept = ~_covered(runs, words.offsets)
        bytes_, place = _joined(data, start[kept], end[kept])
        first = place[np.concatenate([[0], np.cumsum(kept)])[words.offsets]]
        collapsed = [bytes_[a:max(a, b - 1)] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        of = np.searchsorted(runs[:, 0], np.arange(len(words.counts) + 1))
        prints, longest = [], []
        for a, b in zip(of[:-1].tolist(), of[1:].tolist()):
            own = runs[a:b, 1:].tolist()
            prints.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in own).encode()).hexdigest())
            best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=None)
            longest.append(best and dict(zip(("start", "length", "period"), best)))
        run_type = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
        flat = pa.StructArray.from_arrays([pa.array(runs[:, j]) for j in (1, 2, 3)], ["start", "length", "period"])
        return [pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), flat), pa.array(longest, run_type), pa.array(prints),
                pa.array(collapsed, pa.binary()).cast(pa.string()), pa.array(words.counts.astype(np.int64))]

    added = f"{RUNS}, longest struct<start: bigint, length: bigint, period: bigint>, runs_sha256 string, collapsed string, n_words bigint"
    return map_texts(docs, added, compute, text, keep, [reads] if reads else (), limit)


def repeated_tails(keys: list, counts: np.ndarray) -> list:
    """The contract's rewriting: of a tenth of the documents the tail repeats some of its words.

    With h the checksum of the key's decimal text and g = h // 10, every word i >= a of a document with
    h % 10 = 0 becomes word a + (i - a) % p, where a = g % n and p = 1 + (n - a) // (3 + g % 8).  A
    null key has no checksum and leaves its document alone.
    """
    import zlib

    out = []
    for key, n in zip(keys, counts.tolist()):
        h = zlib.crc32(str(key).encode()) if key is not None else 1
        if h % 10 or not n:
            out.append(None)
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        place = np.arange(n)
        out.append(np.where(place < a, place, a + (place - a) % p))
    return out
