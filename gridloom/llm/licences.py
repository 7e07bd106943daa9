"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Whole texts, their paragraphs, lines and sentences are compared, and then, where none of them matches, all windows of the text's words, so that notices
that are wrapped, commented or in the midst of prose are found. For a threshold t a unit can reach a template of n
bigrams only if it has between n*t/(2-t) and n*(2-t)/t of them, which prunes templates by size, and only if it has one of any
n - ceil(n*t/(2-t)) + 1 bigrams of the template, which prunes units: an automaton over these few *anchors* reads each text
once, and units without an anchor are not looked at again. The best windows begin and end with bigrams of the template, and have n*t/(2-t) of them.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import filled, short_batches

THRESHOLD = 0.8

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)

#: Usual notices of public licences, and the short ones whole, as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", _MIT),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License v3.0."),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("ISC", _ISC),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", _MIT + _AS_IS),
    (
        "ISC",
        _ISC + "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
)

_WORD = re.compile(r"[^\W_]+")
_PARTS = re.compile(r"\n\s*\n")
_SENTENCES = re.compile(r"(?<=[.!?;:])\s+")


def words(text: str) -> list[str]:
    """Normalised: lower case, runs of letters and digits; punctuation and layout do not count; the two spellings of the noun are one."""
    return [_SAME.get(w, w) for w in _WORD.findall(text.lower())]


_SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed"}


def bigrams(ws: list[str]) -> Counter:
    return Counter(zip(ws, ws[1:]))


def dice(a: Counter, b: Counter) -> float:
    """Twice the bigrams in common over all bigrams, repeats counted; two empty ones have nothing in common."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        import ahocorasick

        if not 0 < threshold <= 1:
            raise ValueError("the threshold must be over 0 and at most 1")
        self.threshold, self.templates = threshold, []
        self.anchors = ahocorasick.Automaton()
        commons = Counter(g for _, text in templates for g in set(bigrams(words(text))))
        for name, text in templates:
            grams = bigrams(words(text))
            n = grams.total()
            if not n:
                continue
            self.templates.append((n * threshold / (2 - threshold), n * (2 - threshold) / threshold, name, grams))
            free = n - math.ceil(n * threshold / (2 - threshold) - 1e-9) + 1  # so many of them can't all be lacking
            for gram in sorted(grams, key=lambda g: (commons[g], -len(g[0] + g[1]), g)):
                self.anchors.add_word(f" {gram[0]} {gram[1]} ", 1)
                free -= grams[gram]
                if free <= 0:
                    break
        self.anchors.make_automaton()

    def anchored(self, ws: list[str]) -> bool:
        return next(self.anchors.iter(f" {' '.join(ws)} "), None) is not None

    def best(self, ws: list[str]) -> tuple[float, str] | None:
        """The most similar template of at least the threshold, the first of equals."""
        grams, found = bigrams(ws), None
        n = grams.total()
        for least, most, name, template in self.templates:
            if least - 1e-9 <= n <= most + 1e-9:
                d = dice(grams, template)
                if d >= self.threshold and (found is None or d > found[0]):
                    found = (d, name)
        return found

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(licence, start, end, dice) of the units that match, in code points; of units that overlap the most similar, then the longest."""
        if not self.anchored(words(text)):
            return []
        units: list[tuple[int, int]] = [(0, len(text))]
        for a, b in _cut(text, 0, len(text), _PARTS):
            units.append((a, b))
            for c, d in _cut(text, a, b, re.compile("\n")):
                units.append((c, d))
                units.extend(_cut(text, c, d, _SENTENCES))
        hits = []
        for a, b in dict.fromkeys(units):
            ws = words(text[a:b])
            if self.anchored(ws) and (found := self.best(ws)):
                hits.append((-found[0], a - b, a, b, found[1]))
        out = _apart(sorted(hits))
        spots = [(w, m.start(), m.end()) for m in _WORD.finditer(text) for w in words(m[0])]
        while more := self.windows(spots, out):
            out += more
        return sorted(out, key=lambda x: x[1])

    def windows(self, spots: list[tuple[str, int, int]], taken: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
        """Hits like those of ``scan`` among all runs of words that don't overlap ``taken``: for each first word the best, and of these that overlap the best."""
        spans, at = sorted((a, b) for _, a, b, _ in taken), 0
        places: dict[tuple[str, str], list[int]] = {}
        stretch, part = [], 0  # bigrams of one part have no hit between them
        for k, ((v, a, _), (w, _, b)) in enumerate(zip(spots, spots[1:])):
            while at < len(spans) and spans[at][1] <= a:
                at, part = at + 1, part + 1
            free = at == len(spans) or b <= spans[at][0]
            stretch.append(part)
            if free:
                places.setdefault((v, w), []).append(k)
        hits = []
        for least, most, name, template in self.templates:
            n = template.total()
            of = sorted((k, g) for g in template for k in places.get(g, ()))
            need = max(1, math.ceil(least - 1e-9))
            for i in range(len(of) - need + 1):
                first = of[i][0]
                if of[i + need - 1][0] - first + 1 > most + 1e-9:
                    continue
                seen, common, best = Counter(), 0, None
                for k, g in (of[m] for m in range(i, len(of))):
                    size = k - first + 1
                    if size > most + 1e-9 or stretch[k] != stretch[first]:
                        break
                    seen[g] += 1
                    common += seen[g] <= template[g]
                    d = 2 * common / (n + size)
                    if d >= self.threshold and (best is None or d >= best[0]):
                        best = (d, k)
                if best:
                    hits.append((-best[0], first - best[1], spots[first][1], spots[best[1] + 1][2], name))
        return _apart(sorted(hits, key=lambda h: h[:2]))  # of equals the first template


def _apart(hits: list[tuple[float, int, int, int, str]]) -> list[tuple[str, int, int, float]]:
    """Of hits (-dice, .., start, end, licence) in order of preference those that overlap none before them."""
    out: list[tuple[str, int, int, float]] = []
    kept: list[tuple[int, int]] = []
    for score, _, a, b, name in hits:
        spot = bisect.bisect(kept, (a, b))
        if (spot == 0 or kept[spot - 1][1] <= a) and (spot == len(kept) or kept[spot][0] >= b):
            kept.insert(spot, (a, b))
            out.append((name, a, b, -score))
    return out


def _cut(text: str, start: int, end: int, at: re.Pattern) -> Iterator[tuple[int, int]]:
    here = start
    for m in at.finditer(text, start, end):
        if m.start() > here:
            yield here, m.start()
        here = m.end()
    if end > here:
        yield here, end


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...], threshold: float) -> Scanner:
    return Scanner(templates, threshold)


def licence_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (id, n_hits, licence, best_dice, hits): ``hits`` are (licence, start, end, dice) in order, ``licence``
    and ``best_dice`` of the most similar, first among equals.

    Texts that are null or empty or have no match have 0 hits, a null licence and a ``best_dice`` of 0. Repeated rows and null ids
    are carried; an empty table gives an empty result; columns other than the two named are not looked at.
    """
    short_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    hit = T.StructType([T.StructField("licence", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("dice", T.DoubleType())])
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_hits", T.LongType()), T.StructField("licence", T.StringType()), T.StructField("best_dice", T.DoubleType()), T.StructField("hits", T.ArrayType(hit))])
    arrow_hit = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates, threshold)
        for batch in batches:
            found = [scanner.scan(x.as_py()) for x in batch.column(1)]
            top = [max(f, key=lambda h: (h[3], -h[1])) if f else None for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([t and t[0] for t in top], pa.string()),
                    pa.array([t[3] if t else 0.0 for t in top], pa.float64()),
                    pa.array([[dict(zip(("licence", "start", "end", "dice"), h)) for h in f] for f in found], arrow_hit),
                ],
                names=schema.names,
            )

    return docs.select(F.col(id_col).alias(id_col), filled(text_col).alias("text")).mapInArrow(run, schema)
