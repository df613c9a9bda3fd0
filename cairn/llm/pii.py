"""Personal data by patterns and a skip-chain conditional random field (operator 10).

The patterns give the base spans.  Numbers and addresses that no pattern takes are units of a random
field: a unit is tied to its neighbours and to the next unit of the same document with the same
digits or address, or of the same form, and loopy message passing makes their labels agree.  Spans that
the field is sure of are added; base spans are observed and stay.

A unit without a base span may still be personal: the patterns ask for a prefix or a check digit.
Such a unit is unknown when the field is fitted; only units that no kind admits are known to be none.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.words import map_texts, quoted
from cairn.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
#: The field is fitted on about so many different texts, chosen by their hash, and at most so many units.
FIT_DOCUMENTS, FIT_UNITS = 20_000, 50_000
CERTAIN = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails at its first digit fails at every later one, so starts within it are skipped.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[ ().-]{0,2}[0-9])*+")
_WORD = re.compile(r"[^ \t\n\x0b\f\r]+")
_DIGIT, _NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time.

    A match holds one @ and begins where the run of local characters before it begins, or where the
    match before ended.
    """
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        # The next match starts after this @ at the earliest: @ is no local character.
        free = found.end() if found else at + 1
        at = text.find("@", free if found else at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _good_ip(found: str) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in found.split(".")))


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _good_ip(m[0])]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@dataclass
class Units:
    """Units of several documents in order: document, span, label from the base (0: none), features, ties."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    label: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    #: Units whose label is unknown when the field is fitted.
    hidden: np.ndarray | None = None


def _features(text: str, start: int, end: int, digits: str) -> list[float]:
    unit, n = text[start:end], len(digits)
    parts = unit.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    return [1.0, "@" in unit, "@" in unit and "." in unit.rpartition("@")[2].strip("."),
            n < 4, 4 <= n < 7, 7 <= n < 9, 9 <= n <= 12, 13 <= n <= 15, 16 <= n <= 19, n > 19,
            len(parts) == 4, len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts),
            13 <= n <= 19 and luhn(digits), unit[:1] == "+", "(" in unit, "-" in unit or " " in unit,
            before.isalnum(), after.isalnum(), before in "\"'=" and before != "", "@" not in unit and "." in unit]


#: Shape of the unit, then the hashed word before it and the one after it.
N_SHAPE, CONTEXT_BUCKETS, CONTEXT_CHARS = len(_features("0", 0, 1, "0")), 32, 40
N_FEATURES = N_SHAPE + 2 * CONTEXT_BUCKETS


def _context(text: str, start: int, end: int) -> tuple[int, int]:
    """Buckets of the words next to a unit; -1 where there is none."""
    def bucket(word: list[str]) -> int:
        letters = "".join(c for c in word[0].lower() if c.isalpha()) if word else ""
        return zlib.crc32(letters.encode()) % CONTEXT_BUCKETS if letters else -1

    return bucket(text[max(0, start - CONTEXT_CHARS):start].split()[-1:]), bucket(text[end:end + CONTEXT_CHARS].split()[:1])


def _feature_table(shapes: list[list[float]], contexts: list[tuple[int, int]]) -> np.ndarray:
    table = np.zeros((len(shapes), N_FEATURES))
    if shapes:
        table[:, :N_SHAPE] = shapes
        for k, buckets in enumerate(np.array(contexts).T):
            at = np.flatnonzero(buckets >= 0)
            table[at, N_SHAPE + k * CONTEXT_BUCKETS + buckets[at]] = 1
    return table


def _admits(unit: str, digits: str) -> bool:
    """Whether some kind could hold the unit, with or without the prefix or check digit of its pattern."""
    return "@" in unit or 7 <= len(digits) <= 19 or unit.count(".") == 3


def find_units(texts: list[tuple[int, str, list[Span]]]) -> Units:
    """Units of the given (document, text, base spans).

    A base span is a unit; so is every word with an @ and every number phrase beside them.
    """
    rows, features, contexts, hidden, chain, skip = [], [], [], [], [], []
    for doc, text, base in texts:
        found = [(a, b, k + 1) for k, a, b in base]
        found += [(m.start(), m.end(), 0) for m in _WORD.finditer(text) if "@" in m[0]] if "@" in text else []
        found += [(m.start(), m.end(), 0) for m in _NUMBER.finditer(text)]
        taken: list[tuple[int, int, int]] = []
        based = sorted((a, b) for a, b, k in found if k)
        starts = np.array([a for a, _ in based])
        reach = np.maximum.accumulate([b for _, b in based]) if based else np.zeros(0)
        last = -1
        for a, b, k in sorted(found, key=lambda u: (u[0], u[2] == 0, -u[1])):
            if k == 0:
                over = int(np.searchsorted(starts, b)) if len(starts) else 0
                if a < last or over and reach[over - 1] > a:
                    continue
                last = b
            taken.append((a, b, k))
        latest: dict[str, int] = {}
        for i, (a, b, k) in enumerate(taken):
            here, unit = len(rows), text[a:b]
            digits = _NOT_DIGIT.sub("", unit)
            if i:
                chain.append((here - 1, here))
            same = unit.strip(".,;:!?\"'()").lower() if "@" in unit else digits[-9:] if len(digits) >= 7 else ""
            if same:
                form = "@" + same.rpartition("@")[2] if "@" in unit else "#" + _DIGIT.sub("0", unit)
                # The latest unit with the same value, else the latest of the same form.
                tied = latest.get(same, latest.get(form))
                if tied is not None:
                    skip.append((tied, here))
                latest[same] = latest[form] = here
            rows.append((doc, a, b, k))
            features.append(_features(text, a, b, digits))
            contexts.append(_context(text, a, b))
            hidden.append(k == 0 and _admits(unit, digits))
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Units(*table.T, _feature_table(features, contexts), np.array(chain, np.int64).reshape(-1, 2),
                 np.array(skip, np.int64).reshape(-1, 2), np.array(hidden, bool))


@dataclass
class SkipChainField:
    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def fit(cls, units: Units, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> SkipChainField:
        """Pseudo-likelihood: each known label given its unit and the labels it is tied to, by gradient steps.

        Unknown labels give no term and say nothing to their ties.  Every known unit is seen twice, once
        without its shape: the shape of a base span is its pattern, and alone would leave the words
        around it and the ties without weight.
        """
        k = len(KINDS) + 1
        unary, chain, skip = np.zeros((N_FEATURES, k)), np.zeros((k, k)), np.zeros((k, k))
        hidden = np.zeros(len(units.label), bool) if units.hidden is None else units.hidden
        hot = np.eye(k)[units.label] * ~hidden[:, None]
        near, far = np.zeros_like(hot), np.zeros_like(hot)
        for ties, total in ((units.chain, near), (units.skip, far)):
            for a, b in (ties.T, ties.T[::-1]):
                np.add.at(total, a, hot[b])
        known = np.flatnonzero(~hidden)
        hot, near, far, full = hot[known], near[known], far[known], units.features[known]
        blind = full.copy()
        blind[:, 1:N_SHAPE] = 0
        for _ in range(rounds if len(hot) else 0):
            steps = [np.zeros_like(unary), np.zeros_like(chain), np.zeros_like(skip)]
            for features in (full, blind):
                score = features @ unary + near @ chain + far @ skip
                p = np.exp(score - score.max(axis=1, keepdims=True))
                error = (hot - p / p.sum(axis=1, keepdims=True)) / (2 * len(hot))
                for step, seen in zip(steps, (features, near, far)):
                    step += seen.T @ error
            unary += rate * (steps[0] - ridge * unary)
            # One symmetric potential for a tie, whichever end it is seen from.
            for weights, step in ((chain, steps[1]), (skip, steps[2])):
                weights += rate * ((step + step.T) / 2 - ridge * weights)
        return cls(unary, chain, skip)

    def marginals(self, units: Units, rounds: int = 10) -> np.ndarray:
        """Sum-product messages over all ties of all documents at once; base labels are observed."""
        k, n = len(KINDS) + 1, len(units.label)
        local = units.features @ self.unary
        observed = units.label > 0
        local[observed] = np.where(np.eye(k)[units.label[observed]] > 0, 0.0, -30.0)
        ties = np.concatenate([units.chain, units.skip])
        source, target = np.concatenate([ties, ties[:, ::-1]]).T if len(ties) else np.zeros((2, 0), np.int64)
        potential = np.concatenate([np.broadcast_to(self.chain, (len(units.chain), k, k)),
                                    np.broadcast_to(self.skip, (len(units.skip), k, k))])
        potential = np.concatenate([potential, potential])
        back = np.concatenate([np.arange(len(ties)) + len(ties), np.arange(len(ties))])
        message = np.zeros((len(source), k))
        for _ in range(rounds if len(ties) else 0):
            belief = local.copy()
            np.add.at(belief, target, message)
            # What the source thinks without the target's own message, through the tie's potential.
            out = (belief[source] - message[back])[:, :, None] + potential
            top = out.max(axis=1)
            out = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            message = 0.5 * message + 0.5 * (out - out.max(axis=1, keepdims=True))
        belief = local.copy()
        np.add.at(belief, target, message)
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True) if n else p

    def added(self, units: Units, certain: float) -> list[tuple[int, Span]]:
        p = self.marginals(units)
        best = p.argmax(axis=1)
        sure = np.flatnonzero((units.label == 0) & (best > 0) & (p.max(axis=1, initial=0) >= certain))
        return [(int(units.doc[i]), (int(best[i]) - 1, int(units.start[i]), int(units.end[i]))) for i in sure]


def _marked(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, list[Span]]]:
    """Documents with a digit or an @; no other text has spans or units."""
    wanted = ((data >= 48) & (data <= 57)) | (data == 64)
    has = np.diff(np.concatenate([[0], np.cumsum(wanted)])[offsets]) > 0
    out = []
    for i in np.flatnonzero(has).tolist():
        text = data[offsets[i]:offsets[i + 1]].tobytes().decode()
        out.append((i, text, base_spans(text)))
    return out


def fit_field(docs: DataFrame, text: str, fit_documents: int, fit_units: int = FIT_UNITS) -> SkipChainField:
    """The field fitted on a bounded sample of different texts.

    Copies of a text count once.  Texts are taken by their hash until ``fit_documents`` texts or
    ``fit_units`` units are reached; a text with more units than that alone is not fitted on.
    """
    total = docs.count()
    share = int((1 << 20) * min(1.0, fit_documents / max(1, total)))
    key = F.xxhash64(F.col(quoted(text)))
    sample = docs.select(F.col(quoted(text)).alias("text"), key.alias("key")).filter(F.pmod("key", F.lit(1 << 20)) < share)

    def compute(data, offsets, batch):
        units = find_units(_marked(data, offsets))
        at = np.searchsorted(units.doc, np.arange(len(offsets)))
        out = []
        for a, b in zip(at[:-1], at[1:]):
            ties = [(t[(t[:, 0] >= a) & (t[:, 0] < b)] - a).tobytes() for t in (units.chain, units.skip)] if b > a else [b"", b""]
            out.append([int(b - a), units.label[a:b].tobytes(), units.hidden[a:b].tobytes(),
                        units.features[a:b].astype(np.float32).tobytes(), *ties])
        columns = list(zip(*out)) or [[]] * 6
        return [pa.array(columns[0], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[1:]]]

    found = map_texts(sample, "units bigint, label binary, hidden binary, features binary, chain binary, skip binary",
                      compute, "text", ["key"]).filter("units > 0")
    stored = cut_lineage(found.dropDuplicates(["key"]))
    sizes = stored.filter(F.col("units") <= fit_units).select("key", "units").orderBy("key").limit(fit_documents).collect()
    ends = np.cumsum([r["units"] for r in sizes])
    taken = int(np.searchsorted(ends, fit_units, side="right"))
    rows = stored.filter((F.col("units") <= fit_units) & (F.col("key") <= sizes[taken - 1]["key"])).orderBy("key").collect() if taken else []

    def joined_up(name: str, dtype, width: tuple = ()) -> np.ndarray:
        parts = [np.frombuffer(r[name], dtype).reshape(-1, *width) for r in rows]
        return np.concatenate([np.zeros((0, *width), dtype), *parts])

    first = np.cumsum([0, *[r["units"] for r in rows]])
    ties = []
    for name in ("chain", "skip"):
        of = np.repeat(first[:-1], [len(r[name]) // 16 for r in rows])
        ties.append(joined_up(name, np.int64, (2,)) + of[:, None].astype(np.int64))
    none = np.zeros(first[-1], np.int64)
    return SkipChainField.fit(Units(none, none, none, joined_up("label", np.int64), joined_up("features", np.float32, (N_FEATURES,)).astype(float),
                                    *ties, joined_up("hidden", bool)))


def find_personal_data(docs: DataFrame, text: str = "text", certain: float = CERTAIN, fit_documents: int = FIT_DOCUMENTS,
                       keep: list[str] | None = None) -> DataFrame:
    """Documents with ``base`` and ``spans``, arrays of (kind, start, end) by kind and start.

    Positions are code points, the end exclusive; ``spans`` holds the base spans and those that the
    field adds where no base span is.  Null and empty texts have none; repeated rows have the same;
    an empty table gives an empty table.  Columns with the names of the added ones are replaced.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    shared = docs.sparkSession.sparkContext.broadcast(fit_field(docs, text, fit_documents))

    def listed(spans: list[list[Span]]) -> pa.Array:
        return pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(s)] for s in spans], span)

    def compute(data, offsets, batch):
        marked = _marked(data, offsets)
        base = [[] for _ in range(len(offsets) - 1)]
        for doc, _, found in marked:
            base[doc] = found
        every = [list(s) for s in base]
        for doc, found in shared.value.added(find_units(marked), certain):
            every[doc].append(found)
        return [listed(base), listed(every)]

    struct = "array<struct<kind:string,start:bigint,end:bigint>>"
    return map_texts(docs, f"base {struct}, spans {struct}", compute, text, keep)


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def joined(spans: str) -> Column:
    """``kind:start:end`` of every span, by kind as listed and start, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
