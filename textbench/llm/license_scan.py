"""Operator 6: licence scans by Dice coefficient over word bigrams.

Lines, paragraphs and whole texts are normalised to lower-case words of letters
and digits and compared with licence templates by 2 * |A and B| / (|A| + |B|)
over their sets of word bigrams.  A coefficient of t needs set sizes within
t / (2 - t) and (2 - t) / t of each other, so a unit meets only the templates in
its size range; units in no template's range, or without a bigram of any
template, are never compared.  A unit's best template counts (the first by name
among equals).

A notice inside a longer unit is found by windows: for each template, windows of
as many words as it has, from each word whose bigram is one of its own, across
lines.  To reach t a window needs t / (2 - t) of the template's bigrams; those
with fewer hits, counted for all windows at once, are never compared.  Windows
that touch a matching unit say nothing new.  Of windows that overlap, the one
that shares most bigrams is reported (then the one with the greatest
coefficient, the first start, the first template by name), as unit ``window``.

The templates are a fixed small table by default; ``templates`` may hold more
rows, up to ``MOST_TEMPLATES``, which are shipped to every task.

Null or empty text: no units.  Null ``doc_id``: reported with a null id.
Repeated rows are reported each.  Units and templates of one word have no bigrams
and match nothing.  A window is cut at its text's end.  Very long texts are
scanned whole, in time linear in their hits.  Empty tables give no rows.  Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Words, documents, pieces, span_hashes, text_bytes

THRESHOLD = 0.8
MOST_TEMPLATES = 10_000

NOT_WORD = np.ones(256, bool)
NOT_WORD[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = False

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS
OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:"""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at"""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""
_UNLICENSE = """This is free and unencumbered software released into the public domain."""
_APACHE_REST = """http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL_REST = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
<https://www.gnu.org/licenses/>."""
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
_BSD_TWO = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS
OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF
THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original
software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but
is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the
original software. 3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Distributed under the Boost Software License, Version 1.0."""

#: Texts and usual notices of public licences.
TEMPLATES = [
    ("MIT", _MIT), ("MIT", _MIT + _AS_IS), ("MIT", _AS_IS), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "This project is licensed under the MIT License."),
    ("ISC", _ISC), ("BSD", _BSD), ("BSD", "Released under the BSD License."), ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0", _GPL),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."), ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("Apache-2.0", f"{_APACHE} {_APACHE_REST}"), ("GPL-3.0", f"{_GPL} {_GPL_REST}"), ("ISC", f"{_ISC} {_ISC_AS_IS}"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_TWO} {_BSD_AS_IS}"), ("BSD-3-Clause", f"{_BSD} {_BSD_TWO} {_BSD_THIRD} {_BSD_AS_IS}"),
    ("Zlib", _ZLIB), ("BSL-1.0", _BOOST),
]


def _bigrams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bigram hash at each word but the last of its text, and those words."""
    at = words.windows(2)
    return span_hashes(words.hashes(LOWER), at, at + 2), at


class Templates:
    """Bigram sets of all templates, and which template has which bigram."""

    def __init__(self, rows: list[tuple[str, str]]):
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        rows = sorted(set(rows))
        self.names = [name for name, _ in rows]
        words = Words(*text_bytes(pa.array([text for _, text in rows], pa.string())), NOT_WORD)
        grams, at = _bigrams(words)
        of = words.document()[at]
        order = np.unique(np.stack([grams, of.astype(np.uint64)]), axis=1) if len(of) else np.zeros((2, 0), np.uint64)
        self.grams, self.of = order[0], order[1].astype(np.int64)
        self.sizes = np.bincount(self.of, minlength=len(rows))
        self.counts = words.counts
        self.sets = [self.grams[self.of == t] for t in range(len(rows))]

    def near(self, size: int, threshold: float) -> np.ndarray:
        """Templates whose set size allows the threshold."""
        ratio = threshold / (2 - threshold)
        return (self.sizes >= ratio * size - 1e-9) & (self.sizes * ratio <= size + 1e-9) & (self.sizes > 0)

    def having(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Templates that have each of the bigrams: positions in ``grams`` and templates."""
        begin, end = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, side="right")
        count = end - begin
        first = np.cumsum(count) - count
        return (np.repeat(np.arange(len(grams)), count),
                self.of[np.repeat(begin - first, count) + np.arange(count.sum())])

    def best(self, grams: np.ndarray, threshold: float) -> tuple[int, float] | None:
        near = self.near(len(grams), threshold)
        if not near.any():
            return None
        _, hits = self.having(grams)
        shared = np.bincount(hits, minlength=len(self.sizes))
        dice = np.where(near, 2 * shared / (self.sizes + len(grams)), 0.0)
        top = int(np.argmax(dice))
        return (top, float(dice[top])) if dice[top] >= threshold else None


def _units(words: Words) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, first word, end word) of lines, paragraphs and whole texts."""
    breaks = np.flatnonzero(words.data == 10)
    inner = breaks + 1
    cuts = np.unique(np.concatenate([words.bounds[:-1], inner[inner < len(words.data)]]))
    lines = np.searchsorted(words.starts, np.append(cuts, len(words.data)))
    blank = np.flatnonzero(np.diff(lines) == 0)
    parts = np.unique(np.concatenate([words.bounds[:-1], cuts[blank]]))
    paragraphs = np.searchsorted(words.starts, np.append(parts, len(words.data)))
    out, seen = [], np.zeros((0, 2), np.int64)
    for kind, edge in (("line", lines), ("paragraph", paragraphs), ("text", words.first)):
        pair = np.stack([edge[:-1], edge[1:]], 1)
        pair = pair[pair[:, 1] - pair[:, 0] > 1]
        # a paragraph or text of one line is that line
        new = ~np.isin(pair[:, 0] * (len(words.starts) + 1) + pair[:, 1],
                       seen[:, 0] * (len(words.starts) + 1) + seen[:, 1])
        seen = np.concatenate([seen, pair[new]])
        out.append((kind, pair[new, 0], pair[new, 1]))
    return out


def _windows(templates: Templates, threshold: float, by_word: np.ndarray, hits: np.ndarray, ends: np.ndarray,
             taken: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(first word, end word, template, coefficient) of notices inside longer
    units; ``hits`` are the words with a known bigram, ``ends`` their texts' ends,
    ``taken`` marks the words of matching units."""
    where, of = templates.having(by_word[hits])
    covered = np.concatenate([[0], np.cumsum(taken)])
    found = []
    for t in np.unique(of):
        at, last = hits[where[of == t]], ends[where[of == t]]
        end = np.minimum(at + templates.counts[t], last)
        count = np.searchsorted(at, end - 1) - np.arange(len(at))
        need = templates.sizes[t] * threshold / (2 - threshold)
        for i in np.flatnonzero((count >= need - 1e-9) & (covered[end] == covered[at])):
            grams = np.unique(by_word[at[i]:end[i] - 1])
            shared = int(np.isin(grams, templates.sets[t], assume_unique=True).sum())
            dice = 2 * shared / (templates.sizes[t] + len(grams))
            if dice >= threshold:
                found.append((-shared, -dice, int(at[i]), int(t), int(end[i])))
    out, free = [], ~taken
    for _, dice, at, t, end in sorted(found):
        if free[at:end].all():
            free[at:end] = False
            out.append((at, end, t, -dice))
    return sorted(out)


def _scan(rows: list[tuple[str, str]], threshold: float):
    def run(batches):
        templates = Templates(rows)
        low = min(templates.sizes[templates.sizes > 0], default=0) * threshold / (2 - threshold)
        for whole in batches:
            for batch in pieces(whole):
                words = Words(*text_bytes(batch.column("text")), NOT_WORD)
                grams, at = _bigrams(words)
                # bigrams of templates, by word, summed for a quick look at each unit
                place = np.minimum(np.searchsorted(templates.grams, grams), max(len(templates.grams) - 1, 0))
                known = np.zeros(len(words.starts) + 1, np.int64)
                if len(templates.grams):
                    known[at + 1] = templates.grams[place] == grams
                known = np.cumsum(known)
                by_word = np.zeros(len(words.starts), np.uint64)
                by_word[at] = grams
                document, found = words.document(), []
                taken = np.zeros(len(words.starts), bool)
                for kind, first, end in _units(words):
                    # a unit of n words has at most n - 1 bigrams, and all it shares are known
                    hits = known[end - 1] - known[first]
                    tried = np.flatnonzero((end - first - 1 >= low) & (hits > 0))
                    for i in tried:
                        unit = np.unique(by_word[first[i]:end[i] - 1])
                        match = templates.best(unit, threshold)
                        if match:
                            of = document[first[i]]
                            taken[first[i]:end[i]] = True
                            found.append((of, templates.names[match[0]], match[1], kind,
                                          int(first[i] - words.first[of]), int(end[i] - words.first[of])))
                hit = np.flatnonzero(np.diff(known))
                for a, b, t, dice in _windows(templates, threshold, by_word, hit,
                                              words.first[document[hit] + 1], taken):
                    of = document[a]
                    found.append((of, templates.names[t], dice, "window", int(a - words.first[of]),
                                  int(b - words.first[of])))
                columns = list(zip(*found)) if found else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()),
                     pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.string()),
                     pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                    ["doc_id", "license", "dice", "unit", "first_word", "end_word"])
    return run


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, unit, first_word, end_word) of each matching unit and
    window; words are runs of letters and digits, the end is exclusive."""
    rows = TEMPLATES if templates is None else templates
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan(list(rows), threshold),
        "doc_id long, license string, dice double, unit string, first_word long, end_word long")


def op6_license_scan(spark, sf_dir):
    return scan_licenses(documents(spark, sf_dir)).withColumn("dice", F.round("dice", 6))
