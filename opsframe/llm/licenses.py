"""License scans by patience alignment.

A template is aligned with a region of a text: words that occur once in both are anchors, the longest
increasing run of them is kept, and the gaps between kept anchors are aligned in the same way, where
further words have become unique. Coverage is the share of the template's words that are aligned.

Regions are found first: runs of the template's words that aren't further apart than half a template,
cut into overlapping stretches of twice its length, so that a long text or one that holds a notice
several times is aligned piece by piece, and all of it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: License notices by SPDX id.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
}
#: Whole license texts without title and copyright line, and the notices of licenses that are cited by one.
FULL_TEXTS = {
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "BSD-2-Clause": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "BSD-3-Clause": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in
the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""],
    "Unlicense": ["""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make
this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING
FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>"""],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
    "GPL-2.0": ["""This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""],
    "GPL-3.0": ["""This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of
the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""],
    "LGPL-2.1": ["""This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""],
    "MPL-2.0": ["""This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}
LEAST_COVERAGE = 0.8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A-Z lower-cased, nothing else.
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by the first, whose second numbers increase."""
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        before[i] = at[k - 1] if k else -1
        tails[k:k + 1] = [y]
        at[k:k + 1] = [i]
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def patience(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template) of aligned words, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(text), 0, len(template))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = Counter(text[a:b])
        mine = Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if mine[w] == 1}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if once[w] == 1 and w in place])
        if not anchors:
            continue
        out += anchors
        ends = [(a - 1, c - 1), *anchors, (b, d)]
        work += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least = least
        self.all = [(name, t := words(x), Counter(t)) for name, xs in templates.items() for x in xs]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, word after the last) of the best region of each license that is covered, the best ones first.

        Of regions with one coverage that with more aligned words is better, then the first name.
        """
        w = words(text) if text else []
        have = Counter(w)
        best: dict[str, tuple[float, int, int, int]] = {}
        for name, template, vocabulary in self.all:
            # no alignment has more words than text and template share, repeats counted
            if sum(min(n, have.get(x, 0)) for x, n in vocabulary.items()) / len(template) < self.least:
                continue
            at = [i for i, x in enumerate(w) if x in vocabulary]
            own: tuple[float, int, int, int] | None = None
            for regions in (self._regions, self._all_regions):
                for lo, hi in regions(w, at, template, vocabulary):
                    got = patience(w[lo:hi], template)
                    cover = len(got) / len(template)
                    if cover >= self.least and (own is None or (cover, len(got)) > own[:2]):
                        own = cover, len(got), lo + got[0][0], lo + got[-1][0] + 1
                if own:
                    break
            if own and (name not in best or own[:2] > best[name][:2]):
                best[name] = own
        order = sorted(best, key=lambda x: (-best[x][0], -best[x][1], x))
        return [(x, best[x][0], *best[x][2:]) for x in order]

    def _all_regions(self, w: list[str], at: list[int], template: list[str], vocabulary: Counter[str]) -> Iterator[tuple[int, int]]:
        """Every stretch of one and of two template lengths that has enough of the template's words: where steps find nothing, none is left out."""
        need, places = -(-round(self.least * len(template) * 1000) // 1000), np.array(at, dtype=np.int64)
        if len(at) < need:
            return
        for length in (len(template), 2 * len(template)):
            close = places[need - 1 :] - places[: len(places) - need + 1] < length
            begins = np.unique(np.concatenate([np.arange(max(0, places[k + need - 1] - length + 1), places[k] + 1) for k in np.flatnonzero(close).tolist()] or [places[:0]]))
            for lo in begins.tolist():
                have = Counter(x for x in w[lo : lo + length] if x in vocabulary)
                if sum(min(n, vocabulary[x]) for x, n in have.items()) >= self.least * len(template):
                    yield lo, min(len(w), lo + length)

    def _regions(self, w: list[str], at: list[int], template: list[str], vocabulary: Counter[str]) -> Iterator[tuple[int, int]]:
        reach, size = max(3, len(template) // 2), 2 * len(template)
        k = 0
        while k < len(at):
            m = k
            while m + 1 < len(at) and at[m + 1] - at[m] <= reach:
                m += 1
            if m + 1 - k >= self.least * len(template):
                lo, end = at[k], at[m] + 1
                # stretches of one and of two template lengths at steps of a quarter: one holds a whole notice and no second one
                for length in (len(template), size):
                    for start in range(lo, max(lo + 1, end - length + max(1, len(template) // 4)), max(1, len(template) // 4)):
                        yield start, min(end, start + length)
            k = m + 1


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """docs' doc_id with license_id, coverage, start_word, end_word of the best license and licenses, all that were found.

    A license is found where a region covers at least `least` of one of its notices, by default those of
    TEMPLATES and FULL_TEXTS. Null or empty texts and texts without a notice have nulls and an empty list;
    ties go to the notice with more words, then to the first name. Repeated rows stay, other columns are
    ignored, own columns of these names too. Whole texts are scanned.
    """
    small_batches(docs.sparkSession)
    known = {k: TEMPLATES.get(k, []) + FULL_TEXTS.get(k, []) for k in sorted({*TEMPLATES, *FULL_TEXTS})}
    scanner = Scanner(templates or known, least)

    @F.pandas_udf("array<struct<license_id: string, coverage: double, start_word: long, end_word: long>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("license_id", "coverage", "start_word", "end_word")
        for b in batches:
            yield pd.Series([[dict(zip(names, x, strict=True)) for x in scanner.scan(t)] for t in b])

    out = docs.select("doc_id", scan(F.col("text").cast("string")).alias("found"))
    top = F.get("found", F.lit(0))
    return out.select("doc_id", *[top[c].alias(c) for c in ("license_id", "coverage", "start_word", "end_word")], F.col("found.license_id").alias("licenses"))
