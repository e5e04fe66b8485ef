"""License texts in documents, found by patience alignment.

Text and template are aligned on the words that occur exactly once in both: the longest increasing
subsequence of their places is kept, and the gaps between the anchors are aligned in the same way.
Gaps without such words are aligned on all equal words by the same subsequence method. Coverage is the
share of the template's words that are matched in order.

A hit lies within ``reach`` template lengths, foreign words in between included. Before any alignment a
text is cut to windows of that length in which enough words of the template occur (counted with their
multiplicity in the template, an upper bound of coverage; the count slides along the text). So no hit
is missed, every text is read as a whole, and texts without license words cost one lookup per word.
Several licenses and repeated ones in a text are all returned.

Interruptions of any length: the words that stand in runs of at least ``RUN`` words as the
template has them are then searched alone, closed up as if nothing stood between, by the same windows and
alignment. A license cut into pieces of at least that many words is thus found however far apart the pieces
are; other pieces count within ``reach`` only. Such a hit claims the words of its pieces, not what lies between,
and is weighed with 2 * ``RUN`` words less for each piece after the first, so that chance runs do not pay; pieces of ``RUN`` words are left out where the coverage of the others suffices.
Where another license stands between the pieces and has such runs in common with this one, equal words may be
matched in either place, and the one with fewer words, or an edition with more clauses, may be told wrongly.

Words are ASCII-lower-cased and cut at ASCII characters that are no letters or digits.

Defined cases: null and empty texts have no licenses. Texts of any length are scanned as a whole. Of hits that share words, the one with more
matched words is kept (of equals the one of larger coverage, then the first template by name, then the one without interruptions). Repeated rows and null ids are kept as
they are. Other columns, whatever their names, are not read. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraspark.llm.common import slices
from contraspark.llm.words import PUNCTUATION, split_words

LEAST_COVERAGE = 0.8
#: A hit is at most so many template lengths long, interruptions between runs of RUN template words not counted.
REACH = 2
RUN = 4

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
    "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT '
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
    "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_DISCLAIMER = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)

TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the '
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
_GNU = TEMPLATES["GPL-3.0-notice"]
TEMPLATES |= {
    "AGPL-3.0-notice": _GNU.replace("GNU General", "GNU Affero General"),
    "BSD-2-Clause-text": _BSD + _BSD_DISCLAIMER,
    "BSD-3-Clause-text": _BSD + _BSD_ENDORSE + _BSD_DISCLAIMER,
    "ISC-text": TEMPLATES["ISC"] + _ISC_DISCLAIMER,
    "LGPL-3.0-notice": _GNU.replace("GNU General", "GNU Lesser General"),
    "MIT-text": TEMPLATES["MIT"] + _MIT_DISCLAIMER,
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that increases in both places; pairs come by the first place, then falling second."""
    tops, at, back = [], [], [-1] * len(pairs)
    for k, (_, b) in enumerate(pairs):
        pile = bisect_left(tops, b)
        if pile == len(tops):
            tops.append(b)
            at.append(k)
        else:
            tops[pile], at[pile] = b, k
        back[k] = at[pile - 1] if pile else -1
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    return chain[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places (in text, in template), increasing in both."""
    out, todo = [], [(0, len(text), 0, len(template))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and text[a0] == template[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and text[a1 - 1] == template[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_text, in_template = Counter(text[a0:a1]), Counter(template[b0:b1])
        places = {w: b for b, w in enumerate(template[b0:b1], b0) if in_template[w] == 1 and in_text.get(w) == 1}
        anchors = _increasing([(a, places[w]) for a, w in enumerate(text[a0:a1], a0) if w in places])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            out += anchors
            todo += [(x[0] + 1, y[0], x[1] + 1, y[1]) for x, y in zip(edges[:-1], edges[1:], strict=True)]
        else:
            by_word = defaultdict(list)
            for b in range(b1 - 1, b0 - 1, -1):
                by_word[template[b]].append(b)
            out += _increasing([(a, b) for a in range(a0, a1) for b in by_word.get(text[a], ())])
    return sorted(out)


def windows(at: list[int], kind: list[int], counts: list[int], reach: int, need: float) -> Iterator[tuple[int, int]]:
    """Windows lo:hi of at most ``reach`` places in which words of the template occur ``need`` times, each counted up to its number in the template.

    Send the place to go on at, or nothing for the next one.
    """
    inside, overlap, lo, hi = [0] * len(counts), 0, 0, 0
    while lo < len(at):
        while hi < len(at) and at[hi] < at[lo] + reach:
            inside[kind[hi]] += 1
            overlap += inside[kind[hi]] <= counts[kind[hi]]
            hi += 1
        to = (yield lo, hi) if overlap >= need else None
        for _ in range(max(1, (to or 0) - lo)):
            overlap -= inside[kind[lo]] <= counts[kind[lo]]
            inside[kind[lo]] -= 1
            lo += 1


class Scanner:
    def __init__(self, templates: dict[str, str], least: float, reach: int = REACH):
        self.names, self.least, self.reach = sorted(templates), least, reach
        hashed = [split_words(pa.array([templates[n]]), lower=True, separators=PUNCTUATION).hash for n in self.names]
        self.vocabulary = np.unique(np.concatenate(hashed))
        self.words = [np.searchsorted(self.vocabulary, h).tolist() for h in hashed]
        self.counts = np.zeros((len(self.names), len(self.vocabulary)), np.int64)
        for k, words in enumerate(self.words):
            np.add.at(self.counts[k], words, 1)
        self.runs = [np.unique(self._runs(np.array(words, np.int64))) for words in self.words]

    def _runs(self, kinds: np.ndarray) -> np.ndarray:
        """A number for each RUN consecutive kinds."""
        n = max(0, len(kinds) - RUN + 1)
        return sum((kinds[j : j + n].astype(np.int64) * len(self.vocabulary) ** j for j in range(RUN)), np.zeros(n, np.int64))

    def _search(self, k: int, at: np.ndarray, kinds: np.ndarray) -> list[np.ndarray]:
        """The matched indices of each hit of template k among words of these places and kinds."""
        words, counts = self.words[k], self.counts[k]
        kind, need, out = kinds.tolist(), self.least * len(words), []
        search, to = windows(at.tolist(), kind, counts.tolist(), self.reach * len(words), need), None
        while True:
            try:
                lo, hi = search.send(to)
            except StopIteration:
                return out
            # The first window that can do it starts at its first possible word; later starts may match as much.
            matched, to = align(kind[lo:hi], words), None
            if len(matched) >= need:
                out.append(lo + np.array([m[0] for m in matched]))
                to = int(out[-1][-1]) + 1

    def hits(self, places: np.ndarray, kinds: np.ndarray) -> list[tuple[str, float, int, int, int]]:
        """(name, coverage, first word, end, matched) in one text, given the places and kinds of its template words."""
        bound = np.minimum(np.bincount(kinds, minlength=len(self.vocabulary)), self.counts).sum(1)
        found, runs = [], None
        for k in np.flatnonzero(bound >= self.least * self.counts.sum(1)).tolist():
            own = np.flatnonzero(self.counts[k][kinds] > 0)
            for hit in self._search(k, places[own], kinds[own]):
                span = (int(places[own[hit[0]]]), int(places[own[hit[-1]]]) + 1)
                found.append((self.names[k], len(hit) / len(self.words[k]), *span, len(hit), [span]))
            if runs is None:
                runs = self._runs(kinds)
                runs[places[RUN - 1 :][: len(runs)] - places[: len(runs)] != RUN - 1] = -1
            inside = np.zeros(len(kinds), bool)
            starts = np.flatnonzero(np.isin(runs, self.runs[k]))
            for j in range(RUN):
                inside[starts + j] = True
            rest = np.flatnonzero(inside)
            for hit in self._search(k, np.arange(len(rest)), kinds[rest]):
                at = places[rest[hit]]
                groups = np.split(at, np.flatnonzero(np.diff(at) > RUN) + 1)
                longer = [g for g in groups if len(g) > RUN]  # one run alone may stand there by chance
                n = sum(map(len, longer))
                if n < self.least * len(self.words[k]):
                    longer, n = groups, len(hit)
                pieces = [(int(g[0]), int(g[-1]) + 1) for g in longer]
                found.append((self.names[k], n / len(self.words[k]), pieces[0][0], pieces[-1][1], n, pieces))
        taken, kept = [], []
        for hit in sorted(found, key=lambda h: (2 * RUN * (len(h[5]) - 1) - h[4], -h[1], h[0], len(h[5]), h[2])):
            if all(end <= a or first >= b for first, end in hit[5] for a, b in taken):
                taken += hit[5]
                kept.append(hit[:5])
        return sorted(kept, key=lambda h: h[2])


@lru_cache(2)
def _scanner(templates: tuple[tuple[str, str], ...], least: float, reach: int) -> Scanner:
    return Scanner(dict(templates), least, reach)


SPAN = "license string, coverage double, first_word int, end_word int"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, least_coverage: float = LEAST_COVERAGE, reach: int = REACH) -> DataFrame:
    """doc_id and licenses (array of license, coverage, first_word, end_word by place) of each row of ``docs``."""
    items = tuple(sorted(templates.items()))
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int32()), ("end_word", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(items, least_coverage, reach)
        for batch in slices(batches, "text"):
            words = split_words(batch.column(1), lower=True, separators=PUNCTUATION)
            place = np.minimum(np.searchsorted(scanner.vocabulary, words.hash), len(scanner.vocabulary) - 1)
            known = np.flatnonzero(scanner.vocabulary[place] == words.hash)
            edge = np.searchsorted(known, words.first)
            out = []
            for i in range(batch.num_rows):
                own = known[edge[i] : edge[i + 1]]
                hits = scanner.hits(own - words.first[i], place[own]) if len(own) else []
                out.append([{"license": n, "coverage": c, "first_word": a, "end_word": b} for n, c, a, b, _ in hits])
            yield pa.record_batch([batch.column(0), pa.array(out, kind)], ["doc_id", "licenses"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {id_kind}, licenses array<struct<{SPAN.replace(' ', ':').replace(',:', ',')}>>")
