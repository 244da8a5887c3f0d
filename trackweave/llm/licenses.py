"""License scans by patience alignment of texts against templates.

Words that occur once in a stretch of the text and once in the template are anchors; the longest increasing
subsequence of their places keeps the order; the gaps between anchors are aligned in the same way, where other words have
become unique, and equal words at the ends of a gap match directly. Coverage is the share of the template's words
that match.

A find is a stretch of the text, at most SPREAD times as long as the template, whose alignment covers enough of it. One rule
holds for every text: a stretch begins and ends with words that its longest common subsequence with the template needs, without which that would be shorter, and near
a key word. Key words make up more of a template than coverage may leave out, so every find holds one. No stretch aligns better than its longest common
subsequence, which is computed word by word, with bits, from every start; only stretches for which it reaches the coverage, and the words of the best find so far, are
aligned. So time grows with the words near key words times the template's reach, however noisy a text is. Of finds that overlap the one with more words stays, then the shorter, then the first; what lies
before it is searched again, and the search goes on behind it.

Null, empty and short texts have no finds, nor has an empty table. Words are runs of letters and digits, in lower case. Rows are scanned
one by one: repeated rows and rows with a null id have rows of their own in the result. Among a document's finds of one license, that
of most words is told, and of equal ones the first. Columns other than the id and the text play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .shingles import slices

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
_GPL_REST = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"

# Whole texts of public licenses, the whole notices that longer ones ask for, and the one-line forms of both.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": _MIT,
    "MIT-text": f"{_MIT}, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": _APACHE,
    "Apache-2.0-header": f"{_APACHE} Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": _GPL,
    "GPL-3.0-header": f"{_GPL} {_GPL_REST}",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-2-Clause-text": f"{_BSD_HEAD} {_BSD_WARRANTY}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause-text": f"{_BSD_HEAD} {_BSD_NAMES} {_BSD_WARRANTY}",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense-text": f"This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY.replace('AUTHORS OR COPYRIGHT HOLDERS', 'AUTHORS')}",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
#: A find is at most so many times as long as its template.
SPREAD = 4
#: Least share of a template's words that a find must match, in percent.
COVERAGE = 80

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of the first number, the longest subsequence that increases in the second."""
    tails: list[int] = []
    last: list[int] = []
    before = [-1] * len(places)
    for i, (_, b) in enumerate(places):
        k = bisect_left(tails, b)
        before[i] = last[k - 1] if k else -1
        tails[k : k + 1] = [b]
        last[k : k + 1] = [i]
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(places[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of matching words of ``a`` and ``b``, increasing in both."""
    out: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, where[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in where])
        if not anchors:
            continue
        out += anchors
        borders = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        work += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(borders, borders[1:], strict=False)]
    return sorted(out)


class Template:
    """A template's words, which of them are key words, and for each word the bits of its places."""

    def __init__(self, words: list[str], coverage: int):
        self.words, self.size = words, len(words)
        self.least = -(-self.size * coverage // 100)
        self.span = SPREAD * self.size
        self.count = Counter(words)
        self.bits = {w: sum(1 << k for k, x in enumerate(words) if x == w) for w in self.count}

    def common(self, words: list[str], begin: int, end: int) -> list[tuple[int, int]]:
        """(stop, length): for stops up to ``end`` whose last word makes it longer, the longest common subsequence of words[begin:stop] and the template."""
        rest = full = (1 << self.size) - 1
        out, length = [], 0
        for j in range(begin, min(end, begin + self.span)):
            mask = self.bits.get(words[j])
            if mask is not None:
                used = rest & mask
                rest = ((rest + used) | (rest - used)) & full
                n = self.size - rest.bit_count()
                if n > length:
                    length = n
                    out.append((j + 1, n))
        return out

    def best_from(self, words: list[str], begin: int, end: int, more_than: int, rows: dict[int, list[tuple[int, int]]]) -> tuple[int, int, list[int]] | None:
        """The find that starts at ``begin`` and has most words, of those with more than ``more_than``: words, end, places. ``rows`` keeps what ``common`` gave for this start and the next."""
        least = max(self.least, more_than + 1)
        here = rows.pop(begin, None) or self.common(words, begin, end)
        if not here or here[-1][1] < least:
            return None
        rows.clear()
        after = rows[begin + 1] = self.common(words, begin + 1, end)
        shorter = lambda stop: after[k - 1][1] if (k := bisect_left(after, (stop + 1,))) else 0
        stops = [(n, stop) for stop, n in here if n >= least and shorter(stop) < n]
        best = None
        for n, stop in reversed(stops):
            if best is not None and n <= best[0]:
                break  # no later one can be better
            found = [begin + i for i, _ in align(words[begin:stop], self.words)]
            if len(found) >= least and (best is None or len(found) >= best[0]):
                best = len(found), found[-1] + 1, found
        return best

    def finds(self, words: list[str], begin: int, end: int) -> Iterator[list[int]]:
        """Places of the words of all finds between ``begin`` and ``end``, in order."""
        if sum(min(n, c) for w, n in Counter(words[begin:end]).items() if (c := self.count.get(w))) < self.least:
            return
        at = begin
        while at < end:
            best, stop, rows = None, end, {}
            i = at
            while i < stop:  # the finds that overlap the first one compete with it
                if words[i] in self.bits and (found := self.best_from(words, i, end, best[0] - 1 if best else 0, rows)) is not None:
                    rank = found[0], -(found[1] - found[2][0]), -found[2][0]
                    if best is None or rank > (best[0], -(best[1] - best[2][0]), -best[2][0]):
                        stop = found[1] if best is None else stop
                        best = found
                i += 1
            if best is None:
                return
            if best[2][0] - at >= self.least:
                yield from self.finds(words, at, best[2][0])
            yield best[2]
            at = best[1]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: int):
        self.templates = {name: Template(words_of(text), coverage) for name, text in templates.items()}
        common = Counter(w for t in self.templates.values() for w in t.count)
        stop = {"a", "and", "any", "at", "by", "for", "in", "is", "of", "or", "the", "this", "to", "under", "with", "work", "you"}
        self.names: dict[str, list[str]] = defaultdict(list)
        for name, t in self.templates.items():
            keys = 0
            for w in sorted(t.count, key=lambda w: (w in stop, w.isdigit(), common[w], -len(w), w)):
                if keys > t.size - t.least:  # a find can't leave them all out
                    break
                self.names[w].append(name)
                keys += t.count[w]
        self.finder = ahocorasick.Automaton()
        for w in self.names:
            self.finder.add_word(w, w)
        self.finder.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(license, matched, size, first, last) of all finds: words matched, the template's words, and the find's first and last word in the text."""
        low = (text or "").lower()
        if next(self.finder.iter(low), None) is None:
            return []
        words = _WORD.findall(low)
        hits: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            for name in self.names.get(w, ()):
                hits[name].append(i)
        out = []
        for name, places in hits.items():
            t = self.templates[name]
            regions: list[tuple[int, int]] = []
            for i in places:
                low_end, high_end = max(0, i - t.span), min(len(words), i + t.span + 1)
                if regions and low_end <= regions[-1][1]:
                    regions[-1] = regions[-1][0], high_end
                else:
                    regions.append((low_end, high_end))
            for begin, end in regions:
                out += [(name, len(found), t.size, found[0], found[-1]) for found in t.finds(words, begin, end)]
        return sorted(out, key=lambda x: (x[3], x[4], x[0]))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, coverage: int = COVERAGE) -> DataFrame:
    """One row for each document and license found in it: the best coverage, the words of that find, and the number of finds."""
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, coverage)
        for batch in slices(batches):
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                best: dict[str, list] = {}
                for name, matched, size, first, last in scanner.scan(text):
                    old = best.setdefault(name, [matched, size, first, last, 0])
                    old[4] += 1
                    if matched > old[0]:
                        old[:4] = [matched, size, first, last]
                rows += [(i, name, *values) for name, values in sorted(best.items())]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "license", "matched", "size", "first_word", "last_word", "finds"])
        tidy()

    found = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, license string, matched long, size long, first_word long, last_word long, finds long")
    return found.select(F.col("id").alias("doc_id"), "license", "matched", (F.col("matched") / F.col("size")).alias("coverage"), "first_word", "last_word", "finds")
