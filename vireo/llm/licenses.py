"""License scans by patience alignment.

Each text is searched for each license template. Where the words of a template
cluster, the stretch is aligned to the template: words unique to both sides
are anchors, the longest increasing subsequence of anchor pairs is kept, and
the gaps between them are aligned again in the same way. A gap without unique
words is aligned by its longest common subsequence, bit-parallel. The share of
template words that are matched is the coverage, counted in the fullest stretch that
is a tenth longer than the template at most; a template is found where it
reaches its threshold.

Scale: one pass over the whole texts, no shuffle; the templates are a fixed,
small list that travels with the code. Most documents end at a word lookup:
the words a document shares with a template bound its coverage from above, so
what that drops can't match.

Defined results: null, empty or unlicensed texts have no license, coverage 0
and no span; of equal coverages the longer template wins, then the name; rows
that repeat get equal results; a very long text is searched where a template's
words cluster; all other columns pass through, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vireo.llm.common import free_name, map_arrow
from vireo.llm.words import hash_words, lowered, words

#: Public license notices, by SPDX identifier.
BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
BSD_DISCLAIMER = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "GPL-2.0-or-later",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free "
        "Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    ),
    (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
        "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
        "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS "
        "ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", BSD_TERMS + BSD_DISCLAIMER),
    (
        "BSD-3-Clause",
        BSD_TERMS + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. " + BSD_DISCLAIMER,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. "
        "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be "
        "plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
)
COVERAGE = 0.85
#: The stretch that is matched is longer than the template by this share at most, so "BY-NC" is not found as "BY".
EXTRA = 0.1
SLACK = 1.5


def lcs_pairs(a: list, b: list) -> list[int]:
    """Places in ``b`` of a longest common subsequence, bit-parallel over ``a``."""
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    rows = [full]
    for x in b:
        v = rows[-1]
        u = v & places.get(x, 0)
        rows.append(((v + u) | (v - u)) & full)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[j] >> (i - 1) & 1:
            i -= 1
        elif not rows[j - 1] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(j)
    return out[::-1]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs (sorted by the first) whose second rises, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        p = bisect_left(tops, y)
        back.append(piles[p - 1] if p else -1)
        if p == len(tops):
            tops.append(y)
            piles.append(k)
        else:
            tops[p] = y
            piles[p] = k
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(template: list, text: list) -> list[int]:
    """Places in ``text`` of the words that are matched, in order."""
    matched: list[int] = []
    gaps = [(0, len(template), 0, len(text))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and template[a0] == text[b0]:
            matched.append(b0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and template[a1 - 1] == text[b1 - 1]:
            matched.append(b1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(template, a0, a1), _once(text, b0, b1)
        anchors = increasing(sorted((i, once_b[w]) for w, i in once_a.items() if i >= 0 and once_b.get(w, -1) >= 0))
        if not anchors:
            matched += [b0 + k for k in lcs_pairs(template[a0:a1], text[b0:b1])]
            continue
        for i, j in anchors:
            matched.append(j)
            gaps.append((a0, i, b0, j))
            a0, b0 = i + 1, j + 1
        gaps.append((a0, a1, b0, b1))
    return sorted(matched)


def fullest(places: list[int], most: int) -> tuple[int, int, int]:
    """(matches, first, last + 1) of the stretch of ``most`` words at most that has most of ``places``; the first such.

    Matches far off at either end, such as a common word long after the notice, are left out so.
    """
    best, a = (0, 0, 0), 0
    for b, last in enumerate(places):
        while last + 1 - places[a] > most:
            a += 1
        best = max(best, (b + 1 - a, places[a], last + 1), key=lambda x: x[0])
    return best


def _once(items: list, start: int, end: int) -> dict:
    """Position of each word that stands once in the range; -1 for the others."""
    out: dict = {}
    for i in range(start, end):
        out[items[i]] = -1 if items[i] in out else i
    return out


class Scanner:
    def __init__(self, templates=TEMPLATES, coverage: float = COVERAGE):
        self.names = [n for n, _ in templates]
        self.words = [h.tolist() for h in hash_words([t.lower() for _, t in templates], "alnum")]
        self.sizes = np.array([len(w) for w in self.words])
        self.need = np.maximum(1, np.ceil(coverage * self.sizes - 1e-9)).astype(int)
        self.vocabulary = np.unique(np.array([x for w in self.words for x in w], dtype=np.uint64))
        self.counts = np.zeros((len(self.words), len(self.vocabulary)), dtype=np.int64)
        for k, w in enumerate(self.words):
            np.add.at(self.counts[k], np.searchsorted(self.vocabulary, np.array(w, dtype=np.uint64)), 1)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[self.vocabulary >> np.uint64(48)] = True

    def known(self, h: np.ndarray) -> np.ndarray:
        """Positions of the words of ``h`` that stand in some template."""
        at = np.flatnonzero(self.maybe[h >> np.uint64(48)])
        place = np.searchsorted(self.vocabulary, h[at])
        place[place == len(self.vocabulary)] = 0
        return at[self.vocabulary[place] == h[at]]

    def find(self, h: np.ndarray, at: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(template number, coverage, first word, last word + 1) of each template found.

        ``at`` are the positions of known words. Each template's best stretch counts, the best template first.
        """
        ids = np.searchsorted(self.vocabulary, h[at])
        have = np.bincount(ids, minlength=len(self.vocabulary))
        bound = np.minimum(have, self.counts).sum(axis=1)
        found = []
        for k in np.flatnonzero(bound >= self.need).tolist():
            best = self._best(k, h, at[self.counts[k][ids] > 0])
            if best:
                found.append((k, *best))
        # A stretch goes to the template that it covers most of.
        found.sort(key=lambda x: (-x[1], -self.sizes[x[0]], self.names[x[0]]))
        out: list[tuple[int, float, int, int]] = []
        for x in found:
            if all(x[2] >= y[3] or y[2] >= x[3] for y in out):
                out.append(x)
        return out

    def _best(self, k: int, h: np.ndarray, at: np.ndarray) -> tuple[float, int, int] | None:
        """The best aligned stretch that starts at one of the template's own words.

        Stretches of SLACK times the template's length with too few of its
        words, repeats not counted, can't reach the threshold and are left out.
        """
        size, need = int(self.sizes[k]), int(self.need[k])
        width = math.ceil(SLACK * size) + 2
        last = np.searchsorted(at, at + width)
        best, own = None, self.counts[k]
        for s in np.flatnonzero(last - np.arange(len(at)) >= need).tolist():
            got = np.bincount(np.searchsorted(self.vocabulary, h[at[s : last[s]]]), minlength=len(own))
            if np.minimum(got, own).sum() < need:
                continue
            start = int(at[s])
            text = h[start : start + width].tolist()
            got = fullest(patience(self.words[k], text), int(size * (1 + EXTRA) + 1e-9))
            if got[0] >= need and (best is None or got[0] > best[0]):
                best = (got[0], start + got[1], start + got[2])
                if got[0] == size:
                    break
        return (best[0] / size, best[1], best[2]) if best else None


def scan(df: DataFrame, text_col: str = "text", templates=TEMPLATES, coverage: float = COVERAGE, drop_text: bool = True) -> DataFrame:
    """``df`` with the best license of each text and all that were found.

    Adds license, coverage, first_word, last_word (span of the best, in words)
    and licenses (all names found, sorted), with a number after the name where
    ``df`` has such a column. Drops the text unless told not to.
    """
    names = [c for c in df.columns if c != text_col or not drop_text]
    made_cols = [free_name(df, c) for c in ("license", "coverage", "first_word", "last_word", "licenses")]
    kinds = (T.StringType(), T.DoubleType(), T.LongType(), T.LongType(), T.ArrayType(T.StringType()))
    made: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Scanner(templates, coverage))
        own = made[0]
        n = batch.num_rows
        name, share, first, final, every = [None] * n, [0.0] * n, [None] * n, [None] * n, [[] for _ in range(n)]
        for part in words(lowered(batch.column(text_col)), "alnum"):
            known = own.known(part.hashes)
            cuts = np.searchsorted(known, part.bounds)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                found = own.find(part.of(i), known[cuts[i] : cuts[i + 1]] - part.bounds[i])
                if found:
                    k, covered, low, high = found[0]
                    r = part.first + i
                    name[r], share[r], first[r], final[r] = own.names[k], covered, low, high
                    every[r] = sorted({own.names[x[0]] for x in found})
        found_cols = (pa.array(name, pa.string()), pa.array(share, pa.float64()), pa.array(first, pa.int64()), pa.array(final, pa.int64()), pa.array(every, pa.list_(pa.string())))
        return {c: batch.column(c) for c in names} | dict(zip(made_cols, found_cols, strict=True))

    return map_arrow(df, run, T.StructType([*(df.schema[c] for c in names), *(T.StructField(c, k) for c, k in zip(made_cols, kinds, strict=True))]))
