"""License scan: TF-IDF cosine of runs of lines and whole files to templates, then inheritance by directory (operator 7).

Templates are short statements, header notices, whole license texts and the openings of those too long to
be kept whole.  Inverse document frequencies come from all files: exact for words of the templates, by
hashed slots for all others.  Only runs and files that hold a heavy word of some template are compared:
without one their cosine stays below the least one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.skew import key_sizes, salted_lookup_join
from cairn.llm.words import ALNUM, LOWER, SLICE_BYTES, Sums, Words, map_texts, mix, quoted, slices, utf8
from cairn.session import cut_lineage

# Common license statements.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This file is subject to the terms of the Mozilla Public License, version 2.0.",
    "proprietary": "All rights reserved.",
}
# Header notices and license texts as published, without the lines that name the holder.
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_REST = """The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_REST = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_BSD_REST = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED
OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published
by the Free Software Foundation, {version}.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details.
You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."""
_GNU_OPENING = """{name}
Version {version}
Copyright (C) {year} Free Software Foundation, Inc.
Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_GNU = (("GPL-2.0", "GNU General Public License", "either version 2 of the License, or (at your option) any later version", "2, June 1991", "1989, 1991"),
        ("GPL-3.0", "GNU General Public License", "either version 3 of the License, or (at your option) any later version", "3, 29 June 2007", "2007"),
        ("LGPL-2.1", "GNU Lesser General Public License", "either version 2.1 of the License, or (at your option) any later version",
         "2.1, February 1999", "1991, 1999"),
        ("LGPL-3.0", "GNU Lesser General Public License", "either version 3 of the License, or (at your option) any later version",
         "3, 29 June 2007", "2007"),
        ("AGPL-3.0", "GNU Affero General Public License", "either version 3 of the License, or (at your option) any later version",
         "3, 19 November 2007", "2007"))
HEADERS = (
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("MIT", _MIT_GRANT), ("ISC", _ISC_GRANT), ("BSD-2-Clause", _BSD_GRANT), ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD),
    *((name, _GNU_NOTICE.format(name=full, version=version)) for name, full, version, _, _ in _GNU),
)
LICENSE_TEXTS = (
    ("MIT", _MIT_GRANT + _MIT_REST), ("ISC", _ISC_GRANT + _ISC_REST), ("BSD-2-Clause", _BSD_GRANT + _BSD_REST),
    ("BSD-3-Clause", _BSD_GRANT + _BSD_THIRD + _BSD_REST),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the
detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all
present and future rights to this software under copyright law."""),
)
#: A file that begins like this is the license, however long it goes on.
OPENINGS = (
    ("Apache-2.0", """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/
TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    *((name, _GNU_OPENING.format(name=full, version=version, year=year)) for name, full, _, version, year in _GNU),
)
#: Least cosine of a run of lines, and of a whole text that makes its file the license of its directory.
LINE_COSINE, FILE_COSINE = 0.75, 0.6
#: Lengths of the compared runs, in lines with words; runs start at every quarter of their length.
RUN_LINES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Slots of the document frequencies of words that no template has.
SLOTS = 1 << 18
#: Runs are compared in groups of about so many words.
GROUP_WORDS = 1 << 20
#: A directory with more files than this is looked up in several parts.
HOT_FILES = 2048


def _hashed(texts: pa.Array) -> tuple[np.ndarray, Words]:
    data, offsets = utf8(texts)
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    return Sums(data).of(words.start, words.end), words


class Templates:
    """Template vectors over their own words; any other word has the weight of its slot, or of an unseen word.

    ``openings`` are compared with the beginnings of files only.
    """

    def __init__(self, templates: Mapping[str, str] | Iterable[tuple[str, str]], openings: Iterable[tuple[str, str]] = ()):
        pairs = sorted(templates.items() if isinstance(templates, Mapping) else templates)
        openings = sorted(openings)
        self.names = [name for name, _ in [*pairs, *openings]]
        self.opening = np.arange(len(self.names)) >= len(pairs)
        hashes, words = _hashed(pa.array([t for _, t in [*pairs, *openings]], pa.string()))
        self.words, place = np.unique(hashes, return_inverse=True)
        self.counts = np.zeros((len(self.names), len(self.words)))
        np.add.at(self.counts, (words.documents(), place), 1)

    def weigh(self, documents: int, frequency: np.ndarray, slots: np.ndarray | None = None) -> None:
        """Inverse document frequencies from the number of documents and of those with each word."""
        self.weight = np.log((1 + documents) / (1 + frequency)) + 1
        self.other = np.log((1 + documents) / (1 + (np.zeros(SLOTS) if slots is None else slots))) + 1
        table = self.counts * self.weight
        self.table = table / np.linalg.norm(table, axis=1, keepdims=True)

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each word, -1 for one of no template."""
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def heavy(self, cosine: float) -> np.ndarray:
        """Words of which a text must hold one to reach the cosine with some template.

        The cosine is at most the norm of a template over the words that the text holds, so the lightest
        words of a template, as long as their norm stays below, cannot reach it alone.
        """
        out = np.zeros(len(self.words), bool)
        for row in self.table:
            order = np.argsort(row)
            out[order[np.cumsum(row[order] ** 2) >= cosine ** 2 - 1e-9]] = True
        return out

    def cosines(self, unit: np.ndarray, hashes: np.ndarray, units: int) -> np.ndarray:
        """(unit, template) cosines of the units that the words belong to."""
        key = mix(hashes + unit.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first, times = np.unique(key, return_index=True, return_counts=True)
        unit, place = unit[first], self.place(hashes[first])
        value = times * np.where(place >= 0, self.weight[place], self.other[_slot(hashes[first])])
        norm = np.sqrt(np.bincount(unit, value ** 2, units))
        known = np.flatnonzero(place >= 0)
        unit, value, place = unit[known], value[known], place[known]
        dots = np.empty((units, len(self.names)))
        for j, row in enumerate(self.table):
            dots[:, j] = np.bincount(unit, value * row[place], units)
        return dots / np.maximum(norm, 1e-12)[:, None]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % SLOTS


def corpus_frequencies(files: DataFrame, text: str, templates: Templates) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of files, of those that hold each template word, and of those with a word in each slot.

    Every task sums its files in one array of fixed size; the arrays are added by Spark.
    """
    size = len(templates.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + SLOTS + 1, np.int64)
        for batch in batches:
            for part in slices(batch, text, SLICE_BYTES):
                hashes, words = _hashed(part.column(part.schema.get_field_index(text)))
                place = templates.place(hashes)
                key = words.documents() * (size + SLOTS) + np.where(place >= 0, place, size + _slot(hashes))
                total[:-1] += np.bincount(np.unique(key) % (size + SLOTS), minlength=size + SLOTS)
                total[-1] += part.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "n"])

    sums = (files.select(quoted(text)).mapInArrow(count, "place bigint, n bigint")
            .groupBy("place").agg(F.sum("n").alias("n")).toArrow())
    out = np.zeros(size + SLOTS + 1, np.int64)
    out[sums["place"].to_numpy()] = sums["n"].to_numpy()
    return int(out[-1]), out[:size], out[size:-1]


def document_frequencies(files: DataFrame, text: str, templates: Templates) -> tuple[int, np.ndarray]:
    """Number of files, and of those that hold each template word."""
    return corpus_frequencies(files, text, templates)[:2]


def _spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of several ranges one after the other, and the range each belongs to."""
    of = np.repeat(np.arange(len(first)), count)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[of], of


def _runs(line_doc: np.ndarray, marked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first line, end line) of the runs within a document that hold a marked line, by length.

    ``line_doc`` has the document of every line with words, in order.
    """
    before = np.concatenate([[0], np.cumsum(marked)])
    lines = np.arange(len(line_doc))
    first_of = np.searchsorted(line_doc, line_doc)
    end_of = np.searchsorted(line_doc, line_doc, side="right")
    for length in RUN_LINES:
        step = max(1, length // 4)
        start = lines[(lines - first_of) % step == 0]
        end = np.minimum(start + length, end_of[start])
        # A run that the end of its document cuts is a shorter one, unless it is the whole document.
        whole = (end - start == length) | ((start == first_of[start]) & (length < 2 * (end - start)))
        good = whole & (before[end] > before[start])
        yield start[good], end[good]


_FOUND = "own_license string, own_score double, n_license_lines bigint, file_license string, file_score double"


def scan_texts(files: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", line_cosine: float = LINE_COSINE,
               file_cosine: float = FILE_COSINE, keep: list[str] | None = None,
               headers: Iterable[tuple[str, str]] = (*HEADERS, *LICENSE_TEXTS), openings: Iterable[tuple[str, str]] = OPENINGS) -> DataFrame:
    """Files with the best template of any run of lines (``own_license``) and of the whole text (``file_license``).

    Runs are 1 to 32 consecutive lines that have words, so a wrapped header is met whole.  A file is
    also a license file if a run at its beginning is like an opening; that license is then its own, too.
    ``n_license_lines`` counts the single lines that reach the least cosine.  The template is null
    below the least cosine; equal cosines go to the first name, equal runs to the shortest, then
    the first.  Null, empty and wordless texts have none.  Columns with the added names are replaced.
    """
    model = Templates([*templates.items(), *headers], openings)
    model.weigh(*corpus_frequencies(files, text, model))
    in_line, in_file = model.heavy(line_cosine), model.heavy(file_cosine)
    shared = files.sparkSession.sparkContext.broadcast((model, in_line, in_file))

    def compute(data, offsets, batch):
        (model, in_line, in_file), n = shared.value, len(offsets) - 1
        names = np.array(model.names, object)
        hashes, words = _hashed(batch.column(batch.schema.get_field_index(text)))
        doc, place = words.documents(), model.place(hashes)
        # Lines with words: the first word and the document of each.
        cuts = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets]))
        at = np.searchsorted(cuts, words.start, side="right")
        first = np.flatnonzero(np.diff(at, prepend=-1))
        line_end = np.append(first[1:], len(hashes))
        line_doc = doc[first]
        marked = np.bincount(np.searchsorted(first, np.flatnonzero((place >= 0) & in_line[place]), side="right") - 1,
                             minlength=len(first)) > 0
        own, own_score = np.full(n, -1), np.zeros(n)
        begun, begun_score, lines = np.full(n, -1), np.zeros(n), np.zeros(n, np.int64)

        def note(best, score, docs, kept, scores):
            """The best of each document, earlier ones first among equals."""
            good = np.flatnonzero(score >= line_cosine)
            good = good[np.lexsort((good, -score[good], docs[good]))]
            good = good[np.diff(docs[good], prepend=-1) != 0]
            good = good[score[good] > scores[docs[good]]]
            kept[docs[good]], scores[docs[good]] = best[good], score[good]

        for length, (start, end) in zip(RUN_LINES, _runs(line_doc, marked)):
            size = line_end[end - 1] - first[start] if len(start) else np.zeros(0, np.int64)
            group = np.cumsum(size) // GROUP_WORDS
            for g in np.unique(group):
                chosen = np.flatnonzero(group == g)
                word, run = _spread(first[start[chosen]], size[chosen])
                # Rounded, so that equal cosines are equal however their sums were made.
                cosine = model.cosines(run, hashes[word], len(chosen)).round(9)
                docs = line_doc[start[chosen]]
                text_like = np.where(model.opening, 0, cosine)
                best, score = text_like.argmax(axis=1), text_like.max(axis=1, initial=0)
                note(best, score, docs, own, own_score)
                if length == 1:
                    lines += np.bincount(docs[score >= line_cosine], minlength=n)
                heads = np.flatnonzero(start[chosen] == np.searchsorted(line_doc, docs))
                head_like = np.where(model.opening, cosine[heads], 0)
                note(head_like.argmax(axis=1), head_like.max(axis=1, initial=0), docs[heads], begun, begun_score)

        # Whole files, those that hold a heavy word.
        able = np.unique(doc[(place >= 0) & in_file[place]])
        inside = np.isin(doc, able)
        whole = np.where(model.opening, 0, model.cosines(np.searchsorted(able, doc[inside]), hashes[inside], len(able))).round(9)
        file, file_score = np.full(n, -1), np.zeros(n)
        file[able], file_score[able] = whole.argmax(axis=1), whole.max(axis=1, initial=0)
        file[file_score < file_cosine] = -1
        for better, score, target, scores in ((begun, begun_score, file, file_score), (begun, begun_score, own, own_score)):
            use = (better >= 0) & (score > np.where(target >= 0, scores, 0))
            target[use], scores[use] = better[use], score[use]

        def named(index):
            return pa.array(np.where(index >= 0, names[index], None), pa.string())

        return [named(own), pa.array(own_score, mask=own < 0), pa.array(lines), named(file), pa.array(file_score, mask=file < 0)]

    return map_texts(files, _FOUND, compute, text, keep)


def parents(directory: Column) -> Column:
    """The directory and all directories above it, down to the root ""."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def directory_licenses(scanned: DataFrame, path: str) -> DataFrame:
    """(directory, license): of the license files in it the one with the best cosine, then the first path."""
    return (scanned.filter("file_license IS NOT NULL").withColumn("directory", directory_of(F.col(quoted(path))))
            .groupBy("directory").agg(F.min(F.struct((-F.col("file_score")).alias("s"), F.col(quoted(path)).alias("p"),
                                                     F.col("file_license").alias("l"))).alias("best"))
            .select("directory", F.col("best.l").alias("license")))


def directory_of(path: Column) -> Column:
    """The path without its last part and without empty parts; a null path lies in the root."""
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def with_licenses(files: DataFrame, path: str, keep: list[str], hot_files: int = HOT_FILES, **options) -> DataFrame:
    """Files with ``own_license``, ``license`` and ``license_from``.

    A file without a license line of its own takes that of the nearest directory above it that holds
    a license file; ``license_from`` names the directory and is null for an own license.  Each
    directory is looked up once, by equi joins of its parents, and the files of a directory with more than
    ``hot_files`` meet the result in several parts; repeated rows stay, and an empty table gives an
    empty table.
    """
    scanned = cut_lineage(scan_texts(files, keep=[*keep, path], **options).withColumn("directory", directory_of(F.col(quoted(path)))))
    given = directory_licenses(scanned, path).withColumnRenamed("directory", "above")
    above = scanned.select("directory").distinct().withColumn("above", F.explode(parents(F.col("directory"))))
    nearest = (above.join(given, "above").groupBy("directory")
               .agg(F.max(F.struct(F.length("above").alias("n"), "above", "license")).alias("best"))
               .select("directory", F.col("best.above").alias("license_from"), F.col("best.license").alias("inherited")))
    own = F.col("own_license").isNotNull()
    # The table is stored, so the numbers of its rows stay the same in every attempt of a task.
    numbered = scanned.withColumn("__row", F.monotonically_increasing_id())
    found = salted_lookup_join(numbered, nearest, key_sizes(scanned, ["directory"]), ["directory"], "__row", hot_files)
    return found.select(
        *map(quoted, keep), quoted(path), "own_license", "own_score", "n_license_lines", "file_license",
        F.coalesce("own_license", "inherited").alias("license"), F.when(~own, F.col("license_from")).alias("license_from"))
