"""License scans by patience alignment.

A text's words (runs of letters and digits, lower-cased) are aligned with each license template: words that stand once in both are
anchors, the longest increasing run of them is kept, and the gaps between are aligned in the same way; a gap without anchors
gives its equal head and tail.  Coverage is the share of the template's words that are aligned.

Only places that could reach the coverage are aligned: a text must hold enough of the template's words, counted with repeats, and so must a
window of ``slack`` times the template's length.  Both bounds leave out nothing that the alignment could find there.  From each word of the template on, the window
of its length and the one of ``slack`` times that are aligned; the best is reported and the words before and after it are scanned in the same way.  A
short notice or header counts only if the name and version in it stand there too.  Each text is
worked through on its own in the task that read it: no shuffle.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import hashes, series, spans, utf8

# Public license notices, headers and texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0-notice": "Dedicated to the public domain under CC0 1.0.",
    "BSD-3-Clause-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}

# Runs of words that a find of the template must hold: its name and version.
NAMES = {
    "MIT-notice": ["MIT"],
    "Apache-2.0-notice": ["Apache License", "2.0"],
    "GPL-3.0-notice": ["GNU General Public License", "3"],
    "CC-BY-NC-4.0-notice": ["CC BY-NC 4.0"],
    "CC-BY-4.0-notice": ["CC BY 4.0"],
    "CC-BY-SA-4.0-notice": ["CC BY-SA 4.0"],
    "CC0-1.0-notice": ["CC0 1.0"],
    "BSD-3-Clause-notice": ["BSD 3-Clause"],
    "MPL-2.0-header": ["Mozilla Public License", "2.0"],
    "GPL-3.0-header": ["GNU General Public License", "version 3 of"],
    "Apache-2.0-header": ["Apache License", "2.0"],
    "LGPL-2.1-header": ["GNU Lesser General Public License", "2.1"],
    "GPL-2.0-header": ["GNU General Public License", "version 2 of"],
    "AGPL-3.0-header": ["GNU Affero General Public License", "3"],
    "BSD-3-Clause": ["Neither the name"],
}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") + list(range(128, 256))] = True
_LOWER = series(256, 1)
_LOWER[65:91] = _LOWER[97:123]
_LOWER[~_LETTER] = 0
_ARROW = pa.list_(pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("words", pa.int64())]))
KIND = "array<struct<license_id:string,coverage:double,first_word:bigint,words:bigint>>"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a column and each row's first word (one more entry than rows)."""
    data, at = utf8(column)
    starts, ends, first = spans(data, at, ~_LETTER)
    return hashes(data, starts, ends, _LOWER), first


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of aligned equal words of a and b, in order."""
    pairs, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if anchors:
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            pairs += anchors
            todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(pairs)


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, in order of the first entry, whose second entries increase."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int | None] = []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before.append(ends[k - 1] if k else None)
        tails[k : k + 1], ends[k : k + 1] = [y], [i]
    out, at = [], ends[-1] if ends else None
    while at is not None:
        out.append(pairs[at])
        at = before[at]
    return out[::-1]


def trimmed(pairs: list[tuple[int, int]], need: float) -> list[tuple[int, int]]:
    """Pairs without those at either end that are fewer than the other words between them and the rest, if the rest is enough."""
    start, total, best = 0, 0, (0, 0, 0)
    for i in range(len(pairs)):
        gap = pairs[i][0] - pairs[i - 1][0] - 1 if i > start else 0
        start, total = (i, 1) if total < gap else (start, total - gap + 1)
        best = max(best, (total, -start, i + 1))
    rest = pairs[-best[1] : best[2]]
    return rest if len(rest) >= need else pairs


class Scanner:
    """Templates by name, with the bounds of what can reach the coverage."""

    def __init__(self, templates: dict[str, str], coverage: float, slack: float, phrases: dict[str, list[str]]):
        names = [n for n in templates if templates[n]]
        h, at = tokens(pa.array([templates[n] for n in names], pa.string()))
        self.coverage, self.slack = coverage, slack
        self.words = np.unique(h)
        self.sieve = np.zeros(1 << 16, dtype=bool)
        self.sieve[(self.words >> np.uint64(48)).astype(np.int64)] = True
        self.templates = []
        for i, name in enumerate(names):
            own = h[at[i] : at[i + 1]]
            if len(own):
                ids, times = np.unique(np.searchsorted(self.words, own), return_counts=True)
                said = [tokens(pa.array([x], pa.string()))[0].tolist() for x in phrases.get(name, ())]
                self.templates.append((name, own.tolist(), ids, times, said))

    def scan(self, h: np.ndarray, at: np.ndarray) -> dict[int, list[dict]]:
        """Licenses found in each row."""
        maybe = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        good = self.words[place] == h[maybe]
        hit, word = maybe[good], place[good]
        row = np.searchsorted(at, hit, side="right") - 1
        rows, n = len(at) - 1, len(self.words)
        counts = np.bincount(row * n + word, minlength=rows * n).reshape(rows, n)
        found: dict[int, list[dict]] = {}
        for name, own, ids, times, said in self.templates:
            need = self.coverage * len(own) - 1e-9
            limit = np.zeros(n, dtype=np.int64)
            limit[ids] = times
            for r in np.flatnonzero(np.minimum(counts[:, ids], times).sum(axis=1) >= need).tolist():
                mine = row == r
                mine[mine] = limit[word[mine]] > 0
                text = h[at[r] : at[r + 1]].tolist()
                for pairs in self._finds(text, hit[mine] - at[r], word[mine], own, limit, need, said):
                    found.setdefault(r, []).append({"license_id": name, "coverage": len(pairs) / len(own), "first_word": pairs[0][0], "words": pairs[-1][0] - pairs[0][0] + 1, "aligned": len(pairs)})
        return {r: self._best(x) for r, x in found.items()}

    def _best(self, found: list[dict]) -> list[dict]:
        """Of finds that overlap the one with most words aligned, then of best coverage, then first by name."""
        kept: list[dict] = []
        starts: list[int] = []
        ends: dict[int, int] = {}
        for m in sorted(found, key=lambda m: (-m["aligned"], -m["coverage"], m["license_id"], m["first_word"])):
            first, end = m["first_word"], m["first_word"] + m["words"]
            k = bisect_left(starts, end)  # of the places kept that begin before its end, the last one ends last
            if not k or ends[starts[k - 1]] <= first:
                kept.append(m)
                insort(starts, first)
                ends[first] = end
        return sorted(({k: v for k, v in m.items() if k != "aligned"} for m in kept), key=lambda m: m["first_word"])

    def _finds(self, text: list, places: np.ndarray, word: np.ndarray, own: list, limit: np.ndarray, need: float, said: list[list]) -> list[list[tuple[int, int]]]:
        """Aligned pairs of each place of a template, none overlapping, given where its words stand in the text: the most words aligned first, of equal ones the shortest, then the first."""
        size, width = len(own), int(len(own) * self.slack) + 1
        bounds = []
        for i, j in self._windows(places, width, need):
            for k in {int(np.searchsorted(places, places[i] + size)), j}:
                bound = int(np.minimum(np.bincount(word[i:k], minlength=len(limit)), limit).sum())
                if bound >= need:
                    bounds.append((-bound, 0, int(places[i]), int(places[k - 1]) + 1))
        turn = count()
        heap = [(*b, next(turn), None) for b in bounds]  # -words at most, length (0 until aligned, so that of equal words those not aligned come first), start, end, pairs
        heapify(heap)
        aligned: dict[tuple[int, int], list] = {}
        starts: list[int] = []  # of the places taken, in order
        taken: dict[int, int] = {}
        out = []
        while heap:
            bound, _, a, b, _, pairs = heappop(heap)
            k = bisect_left(starts, a + 1)
            low, high = (taken[starts[k - 1]] if k else 0), (starts[k] if k < len(starts) else len(text))
            if a < low or min(b, high) - a < need:
                continue
            if b > high:  # cut at the next place taken, and aligned anew
                heappush(heap, (max(bound, a - high), 0, a, high, next(turn), None))
                continue
            if pairs is None:
                if (a, b) not in aligned:
                    pairs = trimmed(patience(text[a:b], own), need)
                    aligned[a, b] = [(a + x, y) for x, y in pairs] if len(pairs) >= need else []
                pairs = aligned[a, b]
                if pairs and all(self._holds(text[pairs[0][0] : pairs[-1][0] + 1], x) for x in said):
                    heappush(heap, (-len(pairs), 1 + pairs[-1][0] - pairs[0][0], a, b, next(turn), pairs))
                continue
            out.append(pairs)
            taken[pairs[0][0]] = pairs[-1][0] + 1
            insort(starts, pairs[0][0])
        return out

    @staticmethod
    def _holds(words: list, run: list) -> bool:
        return any(words[i : i + len(run)] == run for i in range(len(words) - len(run) + 1))

    def _windows(self, places: np.ndarray, width: int, need: float) -> list[tuple[int, int]]:
        """Runs of places that a window of slack times the template from one of them on holds, if those could be enough."""
        ends = np.searchsorted(places, places + width)
        at = np.flatnonzero(ends - np.arange(len(places)) >= need)
        return list(zip(at.tolist(), ends[at].tolist()))


def scan_licenses(docs: DataFrame, *, templates: dict[str, str] | None = None, coverage: float = 0.8, slack: float = 1.3, names: dict[str, list[str]] | None = None) -> DataFrame:
    """docs with ``licenses``: for each place where a template is covered its id, the coverage, and the first word and number of words of the place.  Of places that overlap the one with most words aligned is kept.

    A null or empty text has none; neither has a template without words.  Templates are a setting, a few pages of text, not data.  A column of
    the name is replaced, others are kept; a find must hold the runs of words that ``names`` has for its template; equal rows are treated alike; an empty table gives an empty result.
    """
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage, slack, names if names is not None else NAMES if templates is None else {})
    out = docs.withColumn("licenses", F.lit(None).cast(KIND))
    names = out.columns
    at_text, at_found = names.index("text"), names.index("licenses")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = scanner.scan(*tokens(part.column(at_text))) if len(scanner.words) else {}
                columns = list(part.columns)
                columns[at_found] = pa.array([found.get(r, []) for r in range(part.num_rows)], _ARROW)
                yield pa.RecordBatch.from_arrays(columns, names)

    return out.mapInArrow(work, out.schema)
