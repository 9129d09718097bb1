"""License scans by patience alignment.

Texts and templates are words of letters and digits (A-Z lowered). Words that
are unique in both a stretch of text and a template are anchors; the longest
increasing run of anchors is kept, and the gaps between them are aligned in the
same way. Coverage is the share of the template's words that align within one
unbroken stretch. Words that tell a license from its relatives (lesser, affero,
nc, sa, version numbers) must all align, and none of them may stand unaligned
inside the stretch; other words of the text between aligned ones may be a third
as many as the template has (a name, a year, a page header). Only texts that
share enough of a template's words to reach the least coverage are aligned,
which loses none. TEMPLATES are common public licenses, not all that exist.

Defined cases: null and empty texts contain no license; every stretch that
reaches the least coverage is a row, repeated notices too; of licenses that
overlap in the text the best covered, then the longest is reported; positions
count words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import textvec

LEAST_COVERAGE = 0.8
#: Unaligned words in a row that end a stretch: so many, or a quarter of the template's if these are more.
MAX_BREAK = 12
#: Unaligned words inside a stretch at most, as a share of the template's words, and how many are always allowed.
MAX_EXTRA, LEAST_EXTRA = 1 / 3, 3

# Public license notices and texts.
_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_LIABLE = "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
TEMPLATES = {
    "MIT-notice": "Released under the MIT License",
    "MIT-licensed": "Licensed under the MIT License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "GPL-3.0-notice": "Licensed under the GNU General Public License, version 3",
    "GPL-2.0-notice": "Licensed under the GNU General Public License, version 2",
    "LGPL-3.0-notice": "Licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1-notice": "Licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0-notice": "Licensed under the GNU Affero General Public License, version 3",
    **{f"CC-{kind}-4.0-notice": f"Licensed under CC {kind} 4.0" for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND")},
    **{f"CC-{kind}-4.0-work": f"This work is licensed under a Creative Commons {name} 4.0 International License" for kind, name in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))},
    "CC0-1.0-notice": "This work is dedicated to the public domain under CC0 1.0 Universal",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": _GNU.format(what="program", name="General Public License", version="3"),
    "GPL-2.0-or-later": _GNU.format(what="program", name="General Public License", version="2"),
    "LGPL-3.0-or-later": _GNU.format(what="library", name="Lesser General Public License", version="3"),
    "LGPL-2.1-or-later": _GNU.format(what="library", name="Lesser General Public License", version="2.1"),
    "AGPL-3.0-or-later": _GNU.format(what="program", name="Affero General Public License", version="3"),
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS " + _LIABLE,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": f"{_BSD} {_BSD_NAMES} {_BSD_END}",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _WARRANTY + " IN NO EVENT SHALL THE AUTHORS " + _LIABLE,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
}
# Words that tell a license from its relatives. Numbers of a template must align too, but may stand beside it, as those of clauses do.
QUALIFIERS = "lesser affero sa nc nd sharealike noncommercial noderivatives noderivs mit apache mozilla eclipse endorse".split()
# Words too common to look for a notice by.
COMMON = "the of and to in a is for or by this with on be it that under as any from an you may not at if was are can all".split()

_SPLIT = np.ones(256, bool)
_SPLIT[48:58] = _SPLIT[65:91] = _SPLIT[97:123] = _SPLIT[128:] = False


def word_ids(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, word hashes, bounds of the rows in them)."""
    for first, last, data, offsets in textvec.chunks(texts):
        starts, ends, rows = textvec.word_bounds(data, offsets, _SPLIT)
        yield first, last, textvec.span_hashes(textvec.LOWER[data], starts, ends), np.searchsorted(rows, np.arange(last - first + 1))


def _one(text: str) -> list[int]:
    return [int(h) for _, _, words, _ in word_ids(pa.array([text])) for h in words]


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by the first) that also increases in the second."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: i for i, w in enumerate(b[b0:b1], b0) if cb[w] == 1}
        anchors = increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if ca[w] == 1 and w in where])
        if not anchors:
            if ca.keys() & cb.keys():  # only repeated words: longest common blocks
                for m in SequenceMatcher(None, a[a0:a1], b[b0:b1], False).get_matching_blocks():
                    out += [(a0 + m.a + x, b0 + m.b + x) for x in range(m.size)]
            continue
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            todo.append((i + 1, i2, j + 1, j2))
        out += anchors
    return sorted(out)


def best_stretch(matches: list[tuple[int, int]], max_break: int = MAX_BREAK) -> tuple[int, int, int]:
    """(aligned words, first position, position after the last) of the fullest stretch without a longer break."""
    best, run = (0, 0, 0), []
    for m in [*matches, None]:
        if m is not None and (not run or m[0] - run[-1][0] <= max_break):
            run.append(m)
            continue
        if run and len(run) > best[0]:
            best = (len(run), run[0][0], run[-1][0] + 1)
        run = [] if m is None else [m]
    return best


class Template:
    def __init__(self, name: str, text: str):
        self.name, self.words = name, _one(text)
        self.times = Counter(self.words)
        common = {h for w in COMMON for h in _one(w)}
        self.telling = set(self.words) - common
        self.qualifiers = {h for w in QUALIFIERS for h in _one(w)}
        numbers = {h for w in re.findall(r"[0-9]+", text) for h in _one(w)}
        self.must = [i for i, w in enumerate(self.words) if w in self.qualifiers or w in numbers]

    def _best(self, words: list[int], least: float) -> tuple[float, int, int, int] | None:
        """(coverage, first word, word after the last, aligned words) of the fullest stretch of a few words, if it is this license."""
        n = len(self.words)
        shared = Counter(words)
        if sum(min(c, shared.get(w, 0)) for w, c in self.times.items()) < least * n:
            return None
        pairs = align(words, self.words)
        got, a, b = best_stretch(pairs, max(MAX_BREAK, n // 4))
        if got < least * n or b - a - got > max(LEAST_EXTRA, MAX_EXTRA * n):
            return None
        inside = {i: j for i, j in pairs if a <= i < b}
        if not set(self.must) <= set(inside.values()) or any(words[i] in self.qualifiers for i in range(a, b) if i not in inside):
            return None
        return got / n, a, b, got

    def find(self, words: np.ndarray, least: float) -> list[tuple[float, int, int, int]]:
        """All stretches of a text that are this license, by windows of three times its length, so that texts full of notices take linear time."""
        n, out = len(self.words), []
        spots = np.flatnonzero(np.isin(words, np.array(sorted(self.telling), np.uint64)))
        cuts = np.flatnonzero(np.diff(spots) > max(4, n // 2)) + 1
        for spot in np.split(spots, cuts) if len(spots) else []:
            lo, end = max(0, int(spot[0]) - n), min(len(words), int(spot[-1]) + n + 1)
            while lo < end:
                hi = min(end, lo + 3 * n)
                found = self._best(words[lo:hi].tolist(), least)
                if found is None:
                    lo = end if hi == end else lo + n
                    continue
                todo = [(lo, lo + found[1])]  # what stands before the fullest may be one as well
                whole = hi == end or not found[1] or hi - lo - found[2] > max(MAX_BREAK, n // 4)
                if whole:
                    out.append((found[0], lo + found[1], lo + found[2], found[3]))
                while todo:
                    x, y = todo.pop()
                    if y - x >= least * n and (more := self._best(words[x:y].tolist(), least)):
                        out.append((more[0], x + more[1], x + more[2], more[3]))
                        todo += [(x, x + more[1]), (x + more[2], y)]
                lo += found[2] if whole else found[1]  # one that the window's end may cut is looked at anew
        return out


def undominated(found: list[tuple]) -> list[tuple]:
    """Of licenses (name, coverage, start, end, aligned) that overlap in the text, the best covered, then the longest."""
    out: list[tuple] = []  # by start, none overlaps another
    for x in sorted(found, key=lambda x: (-x[1], -x[4], x[0], x[2])):
        i = bisect_left(out, x[2], key=lambda y: y[2])
        if (i == len(out) or x[3] <= out[i][2]) and (i == 0 or out[i - 1][3] <= x[2]):
            out.insert(i, x)
    return out


def _scan(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = [Template(k, v) for k, v in TEMPLATES.items()]
        vocab = np.unique(np.array([w for t in templates for w in t.words], np.uint64))
        share = np.array([[t.times.get(int(w), 0) / len(t.words) for t in templates] for w in vocab])
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column(0)
            for first, last, words, bounds in word_ids(batch.column(1)):
                at = np.minimum(np.searchsorted(vocab, words), len(vocab) - 1)
                hit = np.flatnonzero(vocab[at] == words)
                owner = np.searchsorted(bounds, hit, "right") - 1
                pairs = np.unique(owner * len(vocab) + at[hit])
                reach = np.zeros((last - first, len(templates)))
                np.add.at(reach, pairs // len(vocab), share[pairs % len(vocab)])
                for i in np.flatnonzero((reach >= least - 1e-9).any(axis=1)):
                    own = words[bounds[i] : bounds[i + 1]]
                    found = [(templates[k].name, *got) for k in np.flatnonzero(reach[i] >= least - 1e-9) for got in templates[k].find(own, least)]
                    rows += [(ids[first + int(i)].as_py(), *x) for x in undominated(found)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "license", "coverage", "start_word", "end_word", "n_matched"])

    return run


def scan(docs: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """doc_id, license, coverage, start_word, end_word, n_matched for every license found in docs(doc_id, text)."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_scan(least), "doc_id long, license string, coverage double, start_word long, end_word long, n_matched long")
