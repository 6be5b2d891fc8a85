"""License scans by patience alignment.

Words that are unique to both a stretch of text and a template are anchors; the longest
increasing run of anchors is kept, and the gaps between them are aligned in the same way.
What share of the template's words is matched is its coverage.

Short notices of different licenses differ in a word or two, which coverage can't tell
apart.  So the words that name a license and its version must be matched in one piece, and
words of the text between the matched ones count against a match.

A template can only be covered where enough of its words stand close together, so a running
count of its words over the text finds the stretches to align, exactly and in one pass.
Each document is scanned by itself, whole, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches, column


class Template(NamedTuple):
    license_id: str
    text: str
    #: Phrases of the text that a notice must have word for word.
    required: tuple[str, ...] = ()


# What notices call the licenses, and how notices begin.
NAMES = (
    ("MIT", "the", "MIT License"),
    ("ISC", "the", "ISC License"),
    ("Zlib", "the", "zlib License"),
    ("BSD-2-Clause", "the", "BSD 2-Clause License"),
    ("BSD-3-Clause", "the", "BSD 3-Clause License"),
    ("Apache-1.1", "the", "Apache License, Version 1.1"),
    ("Apache-2.0", "the", "Apache License, Version 2.0"),
    ("MPL-2.0", "the", "Mozilla Public License, Version 2.0"),
    ("EPL-2.0", "the", "Eclipse Public License, Version 2.0"),
    ("GPL-2.0", "the", "GNU General Public License, version 2"),
    ("GPL-3.0", "the", "GNU General Public License, version 3"),
    ("LGPL-2.1", "the", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "the", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "the", "GNU Affero General Public License, version 3"),
    ("CC0-1.0", "", "CC0 1.0"),
    ("CC-BY-4.0", "", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "", "CC BY-SA 4.0"),
    ("CC-BY-ND-4.0", "", "CC BY-ND 4.0"),
    ("CC-BY-NC-4.0", "", "CC BY-NC 4.0"),
    ("CC-BY-NC-SA-4.0", "", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "", "CC BY-NC-ND 4.0"),
    ("CC-BY-4.0", "a", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "a", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-ND-4.0", "a", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CC-BY-NC-4.0", "a", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-NC-SA-4.0", "a", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "a", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
)
BEGINNINGS = ("Licensed under", "Released under", "Distributed under", "This work is licensed under", "This software is released under")

# Notices and license texts as they are published.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution."
)
_THIRD_CLAUSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission."
)
_NO_LIABILITY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, "
    "INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_LATER = "as published by the Free Software Foundation, either version"
TEXTS = (
    Template("MIT", _PERMISSION, ("permission is hereby granted free of charge",)),
    Template("MIT", f"{_PERMISSION} {_NO_WARRANTY}", ("permission is hereby granted free of charge",)),
    Template("BSD-2-Clause", f"{_TWO_CLAUSES} {_NO_LIABILITY}", ("redistribution and use in source and binary forms",)),
    Template("BSD-3-Clause", f"{_TWO_CLAUSES} {_THIRD_CLAUSE} {_NO_LIABILITY}", ("redistribution and use in source and binary forms", "neither the name of")),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
        "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
        "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("for any purpose with or without fee",),
    ),
    Template(
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
        "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
        ("altered source versions must be plainly marked",),
    ),
    Template(
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
        ("apache license version 2.0",),
    ),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla public license v 2.0",)),
    *(
        Template(
            f"{short}-{version}.0",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} {_LATER} {version} of the License, or (at your option) any later version.",
            (f"the {name}".lower(), f"version {version}"),
        )
        for short, name, version in (("GPL", "GNU General Public License", 2), ("GPL", "GNU General Public License", 3), ("LGPL", "GNU Lesser General Public License", 3), ("AGPL", "GNU Affero General Public License", 3))
    ),
)
TEMPLATES = (*(Template(short, " ".join(filter(None, (begin, article, f"{name}."))), (name,)) for begin in BEGINNINGS for short, article, name in NAMES), *TEXTS)

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def license_words(text: str | None) -> list[str]:
    """Lower-cased words; dots and hyphens count inside a word only."""
    return _WORD.findall((text or "").lower())


def patience_align(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Matched places (i, j) of ``a`` and ``b``, increasing in both.

    Gaps without a word that is unique on both sides fall back to a longest common
    subsequence; gaps are as short as the stretches that are aligned.
    """
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
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1) if in_b[b[j]] == 1}
        anchors = _longest_increasing([(i, where[a[i]]) for i in range(a0, a1) if in_a[a[i]] == 1 and a[i] in where])
        if not anchors:
            out += _common_subsequence(a, b, a0, a1, b0, b1)
            continue
        out += anchors
        ends = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


def _longest_increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Patience sorting: piles by their top, each card with a link to the pile before."""
    tops: list[int] = []
    cards: list[tuple[int, int]] = []  # (place in pairs, card before)
    last: list[int] = []
    for at, (_, j) in enumerate(pairs):
        pile = bisect_left(tops, j)
        cards.append((at, last[pile - 1] if pile else -1))
        if pile == len(tops):
            tops.append(j)
            last.append(at)
        else:
            tops[pile], last[pile] = j, at
    out, at = [], last[-1] if last else -1
    while at >= 0:
        out.append(pairs[at])
        at = cards[at][1]
    return out[::-1]


def _common_subsequence(a, b, a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    width = b1 - b0
    best = [[0] * (width + 1)]
    for i in range(a1 - 1, a0 - 1, -1):
        after, row = best[-1], [0] * (width + 1)
        for j in range(width - 1, -1, -1):
            row[j] = after[j + 1] + 1 if a[i] == b[b0 + j] else max(after[j], row[j + 1])
        best.append(row)
    best.reverse()
    out, i, j = [], 0, 0
    while i < a1 - a0 and j < width:
        if a[a0 + i] == b[b0 + j]:
            out.append((a0 + i, b0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


class LicenseScanner:
    """Finds templates in texts.

    ``coverage`` is the least share of a template's words that must be aligned, ``purity``
    the least share of aligned words from the first to the last of them in the text.
    """

    def __init__(self, templates: Sequence[Template] = TEMPLATES, coverage: float = 0.85, purity: float = 0.75, slack: float = 1.25) -> None:
        self.coverage, self.purity, self.slack = coverage, purity, slack
        self.templates = []
        for t in templates:
            words = license_words(t.text)
            phrases = [license_words(p) for p in t.required]
            at = [next((k for k in range(len(words)) if words[k : k + len(p)] == p), None) for p in phrases]
            if None in at:
                raise ValueError(f"a notice of {t.license_id} does not have all of its required phrases")
            if words:
                must = [range(k, k + len(p)) for k, p in zip(at, phrases, strict=True)]
                # Words that few texts have are asked for first.
                need = sorted({w for p in phrases for w in p}, key=lambda w: (w in _EVERYDAY, w))
                self.templates.append((t.license_id, words, Counter(words), must, need))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word) of each notice, in order of the text.

        Of notices that overlap, the one with more matched words stays, then the one with
        the better coverage, then the first in the list of templates.
        """
        words = license_words(text)
        there = set(words)
        found = []
        for no, (name, template, count, must, need) in enumerate(self.templates):
            if not there.issuperset(need):
                continue
            least = int(-(-self.coverage * len(template) // 1))
            if sum(n for w, n in count.items() if w in there) >= least:
                found += [(len(pairs), len(pairs) / len(template), -no, name, pairs[0][0], pairs[-1][0]) for pairs in self._places(words, template, count, least, must)]
        found.sort(reverse=True)
        taken: list[tuple[int, int, str, float]] = []  # disjoint, in order
        for _, share, _, name, first, last in found:
            at = bisect_left(taken, (first,))
            if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or taken[at][0] > last):
                insort(taken, (first, last, name, share))
        return [(name, share, first, last) for first, last, name, share in taken]

    def _places(self, words: list[str], template: list[str], count: Counter, least: int, must: list[range]) -> Iterator[list[tuple[int, int]]]:
        hits = np.fromiter((w in count for w in words), np.int64, len(words))
        width = int(len(template) * self.slack) + 1
        until = np.concatenate([[0], np.cumsum(hits)])
        starts = np.flatnonzero(hits)
        dense = until[np.minimum(starts + width, len(words))] - until[starts] >= least
        end = 0
        for at in starts[dense].tolist():
            if at < end:
                continue
            pairs = _tight(self._around(words, template, at, width, end), words)
            if len(pairs) >= least and self._is_pure(pairs, must):
                yield pairs
                end = pairs[-1][0] + 1

    def _is_pure(self, pairs: list[tuple[int, int]], must: list[range]) -> bool:
        """Whether few words stand between the aligned ones, and none in a required phrase."""
        of = {j: i for i, j in pairs}
        whole = all(p[0] in of and all(of.get(j) == of[p[0]] + j - p[0] for j in p) for p in must)
        return whole and len(pairs) >= self.purity * (pairs[-1][0] - pairs[0][0] + 1)

    @staticmethod
    def _around(words: list[str], template: list[str], at: int, width: int, low: int) -> list[tuple[int, int]]:
        """The best alignment of a stretch from ``at`` on, moved to where its own middle match puts the template."""
        best: list[tuple[int, int]] = []
        while True:
            pairs = [(at + i, j) for i, j in patience_align(words[at : at + width], template)]
            if len(pairs) <= len(best):
                return best
            best = pairs
            i, j = pairs[len(pairs) // 2]
            at = max(low, i - j - (width - len(template)) // 2)


def _tight(pairs: list[tuple[int, int]], words: list[str]) -> list[tuple[int, int]]:
    """The same alignment with each word of it as near to the middle one as an equal word of the text lets it be."""
    middle = len(pairs) // 2
    out = pairs[middle : middle + 1]
    for i, j in pairs[middle + 1 :]:
        out.append((next(k for k in range(out[-1][0] + 1, i + 1) if words[k] == words[i]), j))
    for i, j in reversed(pairs[:middle]):
        out.insert(0, (next(k for k in range(out[0][0] - 1, i - 1, -1) if words[k] == words[i]), j))
    return out


_EVERYDAY = frozenset("a the of to for in is and or by with without any name use public general version license 2 3 4.0".split())


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[Template] = TEMPLATES,
    coverage: float = 0.85,
) -> DataFrame:
    """(id, license_id, coverage, first_word, last_word): one row for each notice found.

    Words are numbered from 0 in the whole text.  Null and empty texts hold no notice, and
    documents without one have no row.  A null id and repeated rows are scanned like any
    row; an empty table or an empty list of templates gives no rows, and other columns are
    not read.
    """

    def rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, coverage)
        for batch in batches(parts):
            found = [(doc, *x) for doc, text in zip(column(batch, id_col).to_pylist(), column(batch, text_col).to_pylist(), strict=True) for x in scanner.scan(text)]
            cols = list(zip(*found, strict=True)) or [()] * 5
            kinds = [column(batch, id_col).type, pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "license_id", "coverage", "first_word", "last_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` {kind}, license_id string, coverage double, first_word long, last_word long")
