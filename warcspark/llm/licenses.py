"""License scans: winnowed fingerprints in an inverted index pick candidates, alignment in a band reports coverage and spans.

Words are runs of non-white characters, lower-cased, without punctuation at either end. A match is a local alignment
(1 for a matched word, -1 for one replaced, put in or left out, above 0 all along) that has `need`, the fewest words
that are enough, of a template's n. One with at most n - need words replaced, put in or left out has a run of
need / (n - need + 1) matched words (rounded up) or more. For each template k and window are chosen so that k + window - 1
is that run: of the hashes of its runs of k words, and of the document's, the least of every `window` neighbours is a
fingerprint, so template and document share one in each such run, and no such match is missed. (Others are only
missed if they have no run of that length at all, three words at the default coverage.) Templates of at most
SHORT words are kept whole, with a window of one: each pair of words (or word, where one is enough) that can begin a
match, and a match begins with two matched neighbours, so none is missed. A shared fingerprint is confirmed, made
as long as it goes, and dropped if it is shorter than the run; the best alignment through it is found in a band of n words
to either side of its diagonal, which no alignment above 0 leaves. It gives the matched words, the span, and the
coverage (matched words of the template). Spans of one template that overlap count once, by coverage; templates of
different families report on their own.

Scale: templates travel with the tasks, at most MAX_WORDS words of them; texts are scanned
whole where they are read, and nothing is shuffled.

Defined cases: null and empty texts match nothing; templates without a word match nothing; ties of
coverage go to the earlier span; rows that repeat an id are scanned one by one; empty tables give
empty results; other columns don't matter.

Templates of a family are often parts or near copies of each other. Of their matches that overlap
the one is kept whose matched words exceed its missing ones by most (ties: more words matched,
then the template given first), so a license of three clauses isn't one of two, nor the reverse.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced

COVERAGE, MAX_WORDS, CACHE = 0.75, 200_000, 150_000
_BSD_OPEN = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_CLOSE = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_CLOSE = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"""
_ISC_KEEP = """, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_CLOSE = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {n} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details.
You should have received a copy of the GNU {name} along with this program."""
#: Whole texts of short licenses, the notices that the others ask for, and common one-line notices. Of templates
#: with the same first part of the name (a family) only the one that fits best is reported for a passage.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit": "Released under the MIT License",
    "mit-text": f"{_MIT_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_MIT_CLOSE}",
    "mit-0": f"{_MIT_GRANT}. {_MIT_CLOSE}",
    "mit-grant": _MIT_GRANT,
    "isc": f"{_ISC_GRANT}{_ISC_KEEP} {_ISC_CLOSE}",
    "isc-0bsd": f"{_ISC_GRANT}. {_ISC_CLOSE}",
    "bsd-2-clause": f"{_BSD_OPEN} {_BSD_CLOSE}",
    "bsd-3-clause": f"{_BSD_OPEN} {_BSD_NAMES} {_BSD_CLOSE}",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-2.0-notice": _GNU.format(name="General Public License", n=2),
    "gpl-3.0-notice": _GNU.format(name="General Public License", n=3),
    "gpl-lesser-3.0-notice": _GNU.format(name="Lesser General Public License", n=3),
    "gpl-affero-3.0-notice": _GNU.format(name="Affero General Public License", n=3),
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
}
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…–—©"
_WORD = re.compile(r"\S+")
#: Templates of at most so many words are kept whole. A cell of an alignment is score * ONE + matched words * MATCH + the rest.
SHORT, ONE, MATCH = 40, 1 << 42, 1 << 21


def plain(word: str) -> str:
    return word.strip(_EDGE).lower()


def winnow(ids: np.ndarray, words: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and their places: of the hashes of runs of `words` words, the least of every `window` neighbours (the first
    of equal ones). Runs with a word that no template has (0) have none."""
    n = len(ids) - words + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(words):
        part = ids[j : j + n]
        h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        known &= part > 0
    h[~known] = np.iinfo(np.uint64).max
    if window == 1 or n <= window:
        at = np.arange(n) if window == 1 else np.array([h.argmin()])
    else:
        least = np.lib.stride_tricks.sliding_window_view(h, window).argmin(axis=1)
        at = np.unique(least + np.arange(len(least)))
    at = at[known[at]]
    return h[at], at


class Index:
    def __init__(self, templates: Mapping[str, str]) -> None:
        self.names = list(templates)
        self.words = [[w for w in map(plain, templates[n].split()) if w] for n in self.names]
        if sum(map(len, self.words)) > MAX_WORDS:
            raise ValueError(f"templates have more than {MAX_WORDS} words")
        self.number: dict[str, int] = {}
        for t in self.words:
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
        self.ids = [np.array([self.number[w] for w in t], np.int64) for t in self.words]
        self.made: dict[float, list[tuple[int, int, dict[int, list[tuple[int, int]]], np.ndarray]]] = {}
        self.cache: dict[str, int] = {}

    def of(self, word: str) -> int:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            found = self.cache[word] = self.number.get(plain(word), 0)
        return found

    def run(self, k: int, coverage: float) -> tuple[int, int, int]:
        """The run of words that candidates of a template share, and the words and window of its fingerprints."""
        n = len(self.ids[k])
        need = max(1, math.ceil(coverage * n))
        run = -(-need // (n - need + 1))
        if n <= SHORT or run <= 2:
            return min(need, 2), min(need, 2), 1
        words = (run + 1) // 2
        return run, words, run - words + 1

    def index(self, coverage: float) -> list[tuple[int, int, dict[int, list[tuple[int, int]]], np.ndarray]]:
        """For each number of words and window: (template, place) by fingerprint, and the fingerprints in order."""
        if coverage not in self.made:
            groups: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
            for k, t in enumerate(self.ids):
                if len(t):
                    _, words, window = self.run(k, coverage)
                    last = len(t) - max(1, math.ceil(coverage * len(t))) if len(t) <= SHORT else len(t)
                    hashes, places = winnow(t, words, window)
                    for h, at in zip(hashes.tolist(), places.tolist(), strict=True):
                        if at <= last:
                            groups[words, window][h].append((k, at))
            self.made[coverage] = [(*g, dict(places), np.sort(np.fromiter(places, np.uint64, len(places)))) for g, places in groups.items()]
        return self.made[coverage]

    def candidates(self, ids: np.ndarray, coverage: float = COVERAGE) -> list[tuple[int, int, int]]:
        """(template, its place, the document's place) where runs begin that hold a shared fingerprint."""
        out = {}
        for words, window, places, known in self.index(coverage):
            hashes, at_doc = winnow(ids, words, window)
            if not len(hashes):
                continue
            near = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for j in np.flatnonzero(known[near] == hashes).tolist():
                i = int(at_doc[j])
                for k, at in places[int(hashes[j])]:
                    t, a, b = self.ids[k], at, i
                    while a and b and t[a - 1] == ids[b - 1]:
                        a, b = a - 1, b - 1
                    if (k, a, b) in out:
                        continue
                    size, most = 0, min(len(t) - a, len(ids) - b)
                    while size < most and t[a + size] == ids[b + size]:
                        size += 1
                    if size >= max(self.run(k, coverage)[0], at - a + words):
                        out[k, a, b] = None
        return list(out)

    def align(self, ids: np.ndarray, k: int, at: int, i: int) -> tuple[int, int, int]:
        """Matched words, first and last place of the best alignment in which places at and i match.

        Rows are the template's words, columns the diagonals of the band; a cell packs score, matched words and how early it began.
        """
        t = self.ids[k]
        n = len(t)
        first = i - at - n  # the document's place at the band's left edge, in the first row
        near = np.full(3 * n + 1, -1, np.int64)
        low, high = max(first, 0), min(first + len(near), len(ids))
        near[low - first : high - first] = ids[low:high]
        slope = np.arange(2 * n + 1, dtype=np.int64) * ONE

        def alive(cells: np.ndarray) -> np.ndarray:
            cells = np.maximum.accumulate(cells + slope) - slope
            return np.where(cells >= ONE, cells, 0)

        def step(cells: np.ndarray, r: int, fresh: bool) -> np.ndarray:
            less = np.where(cells >= 2 * ONE, cells - ONE, 0)
            begun = ONE + MATCH + (MATCH - 1 - r - np.arange(2 * n + 1)) if fresh else 0
            diagonal = np.where(near[r : r + 2 * n + 1] == t[r], np.where(cells > 0, cells + ONE + MATCH, begun), less)
            return alive(np.maximum(diagonal, np.append(less[1:], 0)))

        cells = np.zeros(2 * n + 1, np.int64)
        for r in range(at + 1):
            cells = step(cells, r, True)
        through = cells[n]
        cells = np.zeros(2 * n + 1, np.int64)
        cells[n] = through
        best, end, cells = int(through), i, alive(cells)
        for r in range(at + 1, n):
            cells = step(cells, r, False)
            d = int(cells.argmax())
            if cells[d] // MATCH > best // MATCH:
                best, end = int(cells[d]), first + r + d
            if not cells[d]:
                break
        return best // MATCH % (ONE // MATCH), first + MATCH - 1 - best % MATCH, end

    def matches(self, text: str | None, coverage: float = COVERAGE, *, every: bool = False) -> list[tuple[str, float, int, int, int, int]]:
        """(template, coverage, first word, last word, first character, end character) of each match: the best of a
        family, or those of every template."""
        words = text.split() if text else []
        if not words:
            return []
        ids = np.fromiter(map(self.of, words), np.int64, len(words))
        got: dict[int, list[tuple[float, int, int]]] = defaultdict(list)
        for k, at, i in self.candidates(ids, coverage):
            m, a, b = self.align(ids, k, at, i)
            if m >= coverage * len(self.ids[k]):
                got[k].append((m / len(self.ids[k]), a, b))
        if not got:
            return []
        span = [m.span() for m in _WORD.finditer(text)]
        families: dict[str, list[tuple[int, float, int, int]]] = defaultdict(list)
        for k, found in got.items():
            kept: list[tuple[float, int, int]] = []
            for c, a, b in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
                if all(b < x[1] or a > x[2] for x in kept):
                    kept.append((c, a, b))
            families[self.names[k] if every else self.names[k].split("-")[0]] += [(k, *x) for x in kept]
        out = []
        for found in families.values():
            best: list[tuple[int, float, int, int]] = []
            for k, c, a, b in sorted(found, key=lambda x: (-(2 * x[1] - 1) * len(self.ids[x[0]]), -x[1] * len(self.ids[x[0]]), x[0], x[2])):
                if all(b < x[2] or a > x[3] for x in best):
                    best.append((k, c, a, b))
            out += [(self.names[k], c, a, b, span[a][0], span[b][1]) for k, c, a, b in best]
        return sorted(out, key=lambda x: (x[2], x[0]))


OUT = ["license", "coverage", "first_word", "last_word", "first_char", "end_char"]


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, *, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, license, coverage and span of each match in docs (doc_id, text)."""
    given = dict(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(given)
        for b in sliced(batches):
            rows = [(i, *m) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in index.matches(text, coverage)]
            types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["doc_id", *OUT])

    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(run, "doc_id long, license string, coverage double, first_word long, last_word long, first_char long, end_char long")
