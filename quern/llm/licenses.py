"""License scans by patience alignment.

A text is read in windows of 1.25, 2 and 3 times a template's length, which start a quarter, half and the
whole of it apart, so a copy nearly fills one of the first, and every stretch of twice the template lies
whole in one of the last. In a window, words that are unique both to it and to the template are anchors;
the longest increasing subsequence of their places is kept, and the gaps between anchors are aligned in
the same way. A gap without such words is aligned by a longest common subsequence. Words at the ends
that lie far from the rest are moved nearer or left out. The share of the template's words that are
aligned is its coverage; 0.8 or more, over a stretch of text not longer than twice the template, is a
finding. A window is only aligned if it holds enough of the template's words, counted with repeats, to
reach that coverage at all, so nothing is missed by skipping. Foreign words between never hide a copy;
many of the template's own words strewn in may, as they are no anchors then.

Of findings that overlap, that with most aligned words is kept, then the shorter, then the earlier; what it
spans is taken out and the rest read again until nothing more is found, so ``times`` counts stretches that
do not overlap. A finding is dropped if one of another template overlaps half of it or more and has higher
coverage and no fewer words; or the same coverage and more words, if this one has gaps.

Each task reads its documents on its own; the templates are constants of the code. Nothing is
shuffled, collected or joined.

Defined cases: null and empty texts have no finding; a notice that occurs many times is one finding
with its count, the place being that of the copy with the best coverage, the first of equal ones; texts of any length are read whole; repeated rows each give their findings; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import common

COVERAGE, STRETCH = 0.8, 2.0
#: Windows as (width, stride) in template lengths, and what a word between aligned ones counts against them.
WINDOWS, APART = ((1.25, 0.25), (2, 0.5), (3, 1)), 0.25
PIECE = 1 << 20
_WORD = re.compile(r"\w+")

# Wording of public licenses and of the notices that refer to them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "MIT notice": "Released under the MIT License.",
    "All rights reserved": "All rights reserved.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CDDL-1.0 notice": "The contents of this file are subject to the terms of the Common Development and Distribution License (the License). You may not use this file except in compliance with the License.",
    "BSL-1.0 notice": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MIT full text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC full text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-3-Clause full text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _rising(places: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence."""
    tops, at, back = [], [], []
    for i, p in enumerate(places):
        pile = bisect_left(tops, p)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[pile], at[pile] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of a longest common subsequence."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int], i0: int = 0, j0: int = 0) -> list[tuple[int, int]]:
    """Aligned places (in ``a``, in ``b``) by patience: unique common words first, then their gaps."""
    once_a, once_b = Counter(a), Counter(b)
    place = {w: j for j, w in enumerate(b) if once_b[w] == 1}
    both = [(i, place[w]) for i, w in enumerate(a) if once_a[w] == 1 and w in place]
    if not both:
        if not once_a.keys() & once_b.keys():
            return []
        return [(i + i0, j + j0) for i, j in _common(a, b)]
    keep = [both[k] for k in _rising([j for _, j in both])]
    out, i, j = [], 0, 0
    for x, y in [*keep, (len(a), len(b))]:
        if i < x and j < y:
            out += align(a[i:x], b[j:y], i0 + i, j0 + j)
        if x < len(a):
            out.append((x + i0, y + j0))
        i, j = x + 1, y + 1
    return out


class Scanner:
    """Templates as word numbers."""

    def __init__(self, templates: dict[str, str]):
        split = {name: words(t) for name, t in templates.items()}
        self.number = {w: k for k, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
        self.templates = []
        self.longest = int(STRETCH * max((len(ws) for ws in split.values()), default=0)) + 1
        for name, ws in split.items():
            ids = [self.number[w] for w in ws]
            has = np.zeros(len(self.number) + 1, bool)  # the last is for unknown words
            has[ids] = True
            self.templates.append((name, ids, has, Counter(ids)))

    def _numbers(self, text: str) -> Iterator[np.ndarray]:
        get, unknown, at = self.number.get, len(self.number), 0
        while at < len(text):
            end = at + PIECE
            while end < len(text) and not text[end].isspace():
                end += 1
            yield np.array([get(w, unknown) for w in words(text[at:end])], np.int64)
            at = end

    def _stretches(self, ids: np.ndarray, template: list[int], has: np.ndarray, count: Counter, only=None) -> list[tuple[int, int, int]]:
        """(aligned words, first, last) of each window that holds the template; windows that meet ``only``, if given."""
        n = len(template)
        need = int(np.ceil(COVERAGE * n - 1e-9))
        known = np.concatenate([[0], np.cumsum(has[ids])])
        if known[-1] < need:
            return []
        out = set()
        for width, stride in WINDOWS:
            width, stride = int(np.ceil(width * n)), max(1, int(stride * n))
            starts = np.arange(0, max(1, len(ids) - width + stride), stride)
            ends = np.minimum(starts + width, len(ids))
            enough = known[ends] - known[starts] >= need
            if only is not None:
                touched = np.concatenate([[0], np.cumsum(only)])
                enough &= touched[ends] > touched[starts]
            for s, e in zip(starts[enough].tolist(), ends[enough].tolist()):
                inside = np.flatnonzero(has[ids[s:e]])
                own = ids[s:e][inside].tolist()
                if (Counter(own) & count).total() < need:
                    continue
                pairs = align(own, template)
                if len(pairs) < need:
                    continue
                at = _together(own, inside.tolist(), pairs, need)
                if at[-1] - at[0] + 1 <= STRETCH * n:
                    out.add((len(at), s + at[0], s + at[-1]))
        return sorted(out, key=lambda f: (-f[0], f[2] - f[1], f[1]))

    def scan(self, text: str | None) -> list[tuple]:
        """(license, coverage, times, first word, words spanned) of each template found."""
        parts = list(self._numbers(text or ""))
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found: list[tuple[str, float, int, int, int]] = []
        for name, template, has, count in self.templates:
            left, changed = ids, None
            while stretches := self._stretches(left, template, has, count, changed):
                left, changed = left.copy(), np.zeros(len(left), bool)
                free = np.ones(len(left), bool)
                for words_, first, last in stretches:
                    if free[first : last + 1].all():
                        free[first : last + 1] = False
                        found.append((name, words_ / len(template), words_, first, last))
                        changed[max(0, first - 3 * len(template)) : last + 1 + 3 * len(template)] = True
                left[~free] = len(self.number)
        kept: dict[str, list[tuple[float, int, int]]] = {}
        found.sort(key=lambda f: f[3])
        for k, (name, coverage, words_, first, last) in enumerate(found):
            better = any(
                g[0] != name and (g[1] > coverage and g[2] >= words_ or g[1] == coverage and g[2] > words_ < last - first + 1) and 2 * (min(last, g[4]) - max(first, g[3]) + 1) >= last - first + 1
                for g in _around(found, k, self.longest)
            )
            if not better:
                kept.setdefault(name, []).append((-coverage, first, last - first + 1))
        best = {name: min(copies) for name, copies in kept.items()}
        return [(name, -best[name][0], len(kept[name]), best[name][1], best[name][2]) for name, *_ in self.templates if name in kept]


def _around(found: list[tuple], k: int, reach: int) -> Iterator[tuple]:
    """Findings, ordered by place, that may overlap the k-th."""
    i = k - 1
    while i >= 0 and found[i][3] + reach > found[k][3]:
        yield found[i]
        i -= 1
    i = k + 1
    while i < len(found) and found[i][3] <= found[k][4]:
        yield found[i]
        i += 1


def _together(own: list[int], place: list[int], pairs: list[tuple[int, int]], need: int) -> list[int]:
    """Places in the window of aligned words: ends are moved as near to the middle as equal words allow, and the
    run of words is kept that counts most, one each less APART for every word between, if ``need`` remain."""
    at = [i for i, _ in pairs]
    middle = len(at) // 2
    for k in range(middle - 1, -1, -1):
        at[k] = next(i for i in range(at[k + 1] - 1, at[k] - 1, -1) if own[i] == own[at[k]])
    for k in range(middle + 1, len(at)):
        at[k] = next(i for i in range(at[k - 1] + 1, at[k] + 1) if own[i] == own[at[k]])
    at = [place[i] for i in at]
    best, total, start = (0.0, 0, 0), 0.0, 0
    for k, p in enumerate(at):
        apart = APART * (p - at[k - 1] - 1) if k else 0.0
        if total - apart <= 0:
            total, start = 0.0, k
        else:
            total -= apart
        total += 1
        best = max(best, (total, -start, k))
    run = at[-best[1] : best[2] + 1]
    return run if len(run) >= need else at


def find(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """A row per document and license found in it."""
    scanner = Scanner(templates)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, m, *f) for i, m, t in zip(batch["doc_id"], batch["missing"], batch["text"]) for f in scanner.scan(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "missing", "license", "coverage", "times", "first_word", "span"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("missing"), "text")
    out = rows.mapInPandas(run, "doc_id long, missing boolean, license string, coverage double, times int, first_word long, span int")
    return out.withColumn("doc_id", F.when(~F.col("missing"), F.col("doc_id"))).drop("missing")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every license found in a document."""
    return find(common.read_table(spark, sf_dir, "documents"))
