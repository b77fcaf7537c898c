"""License notices in texts: winnowed fingerprints, an inverted index, and banded alignment.

Templates and texts are sequences of normalised words (lower-cased runs of letters and digits). Of each ``WINNOW``
neighbouring ``GRAM``-word hashes the least is a fingerprint, so that every shared run of GRAM + WINNOW - 1 words
shares one. Fingerprints of the templates make an inverted index; a text's hits name candidates, and the template is
aligned to the words round its hits within a band. A match is reported if enough of the template is found in order, and
if nothing in the matched words tells of another license: its clauses (non-commercial, Affero, ...) must be those of the
template, and the numbers that stand for a version there must be the template's, though some may be missing.
The templates are a fixed, short list (a parameter); texts are read once and nothing is shuffled.

Defined results: null, empty and clean texts have no rows; where matches overlap, the one with most matched words
stays (then the one that is covered more, then the template first in name order); templates shorter than GRAM words are
matched by no text; repeated rows are reported each. Very long texts are read whole, one at a time. An empty table gives
an empty result. Columns other than the text and the carried ones aren't looked at, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._align import local_alignment
from ._store import in_batches
from ._words import NOT_WORD, HashIndex, hashes, row_slices, spans, text_bytes, windows

GRAM = 3
WINNOW = 2
COVERAGE = 0.8

#: Words that tell licenses of one family apart, those that a version's number follows, and such numbers; fixed values.
CLAUSES = "nc nd sa noncommercial noderivatives noderivs sharealike affero lesser library".split()
BEFORE_VERSION = "version v by nc nd sa attribution noncommercial noderivatives noderivs sharealike license licence cc0 gpl lgpl agpl mpl".split()
VERSIONS = [str(i) for i in range(1, 21)]
#: The terms of Creative Commons licenses by their short names; fixed values.
_CC = {"BY": "", "BY-SA": "-ShareAlike", "BY-NC": "-NonCommercial", "BY-ND": "-NoDerivatives", "BY-NC-SA": "-NonCommercial-ShareAlike", "BY-NC-ND": "-NonCommercial-NoDerivatives"}

#: Common public notices, whole; fixed values. The sentences that several share stand first.
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
    "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GNU = (
    "This {what} is free software{mark} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the "
    "Free Software Foundation{either} version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it "
    "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU "
    "{name}General Public License for more details. You should have received a copy of the GNU {name}General Public License along with this {what}{end}"
)
_SEE = ". If not, see https://www.gnu.org/licenses/."
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "AGPL-3.0 line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 notice": _GNU.format(what="program", mark=":", name="Affero ", either=", either", version=3, end=_SEE),
    "BSD-2-Clause": _BSD_HEAD + _BSD_END,
    "BSD-3-Clause": _BSD_HEAD + _BSD_THIRD + _BSD_END,
    **{f"CC-{short}-4.0 line": f"Licensed under CC {short} 4.0." for short in _CC},
    **{f"CC-{short}-4.0 notice": f"This work is licensed under a Creative Commons Attribution{terms} 4.0 International License." for short, terms in _CC.items()},
    "CC0-1.0 notice": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "
        "This work is published under the CC0 1.0 Universal Public Domain Dedication."
    ),
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 notice": _GNU.format(what="program", mark=";", name="", either="; either", version=2, end=_WRITE),
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 notice": _GNU.format(what="program", mark=":", name="", either=", either", version=3, end=_SEE),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        'copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD '
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "LGPL-2.1 notice": _GNU.format(what="library", mark=";", name="Lesser ", either="; either", version="2.1", end=_WRITE),
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 notice": _GNU.format(what="program", mark=":", name="Lesser ", either=", either", version=3, end=_SEE),
    "MIT line": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the "
        "public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. "
        "For more information, please refer to https://unlicense.org"
    ),
}


def winnow(keys: np.ndarray, at: np.ndarray, row: np.ndarray, width: int = WINNOW) -> np.ndarray:
    """Indices of the hashes that are the least (the last of equals) of some ``width`` neighbours within a row."""
    n = len(keys)
    if n == 0:
        return np.zeros(0, np.int64)
    picked = np.zeros(n, bool)
    first = np.searchsorted(row, row, "left")
    end = np.searchsorted(row, row, "right")
    picked[(end - first) < width] = True  # too short for a window: all
    if n >= width:
        best = np.arange(n - width + 1)
        for j in range(1, width):
            other = np.arange(n - width + 1) + j
            best = np.where(keys[other] <= keys[best], other, best)
        whole = row[: n - width + 1] == row[width - 1 :]
        picked[best[whole]] = True
    return np.flatnonzero(picked)


def _hashed(words: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(words, pa.string()))
    return hashes(data, offsets[:-1], offsets[1:])


def dotted(data: np.ndarray, s) -> np.ndarray:
    """Whether a full stop alone stands between each word and the one before, as within a version."""
    out = np.zeros(len(s), bool)
    if len(s):
        out[1:] = (s.starts[1:] - s.ends[:-1] == 1) & (data[s.starts[1:] - 1] == 0x2E)
    return out


class Marks:
    """What tells licenses of a family apart in a run of words: its clauses, and the numbers of versions in order."""

    def __init__(self):
        self.clauses, self.before, self.versions = _hashed(CLAUSES), _hashed(BEFORE_VERSION), _hashed(VERSIONS)
        self.zero = _hashed(["0"])[0]

    def of(self, words: np.ndarray, stops: np.ndarray, lo: int, hi: int, before: int = 0, after: int = 0) -> tuple[set[int], list[int]]:
        """Clauses of the words from ``lo`` to ``hi``; versions in these, in ``before`` and ``after`` more words, and in a
        version's further digits behind them. A 0 says nothing."""
        clauses = set(words[lo:hi][np.isin(words[lo:hi], self.clauses)].tolist())
        lo, hi = max(0, lo - before), min(len(words), hi + after)
        number = np.isin(words[lo : hi + 2], self.versions) | (words[lo : hi + 2] == self.zero)
        found, last = [], False
        for i, is_number in enumerate(number.tolist()):
            at = lo + i
            if at >= hi and not (last and stops[at]):
                break
            last = is_number and (last and bool(stops[at]) or at > 0 and bool(np.isin(words[at - 1], self.before)))
            if last and words[at] != self.zero:
                found.append(int(words[at]))
        return clauses, found

    @staticmethod
    def agree(text: tuple[set[int], list[int]], template: tuple[set[int], list[int]]) -> bool:
        """The same clauses, and no number in the text that the template lacks there."""
        rest = iter(template[1])
        return text[0] == template[0] and all(x in rest for x in text[1])


class Index:
    """Fingerprint -> (template, place) of the templates."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        data, offsets = text_bytes(pc.utf8_lower(pa.array([templates[n] for n in self.names], pa.string())))
        s = spans(data, offsets, NOT_WORD)
        self.words, self.rows = hashes(data, s.starts, s.ends), s.rows
        keys, at = windows(self.words, self.rows, GRAM)
        row = s.row_of()[at] if len(at) else at
        mine = winnow(keys, at, row)
        order = mine[np.argsort(keys[mine], kind="stable")]
        own, first = np.unique(keys[order], return_index=True)
        self.first, self.template, self.place = np.append(first, len(order)), row[order], (at - self.rows[row])[order]
        self.find = HashIndex(own).find
        self.marks, stops = Marks(), dotted(data, s)
        self.marked = [self.marks.of(self.of(t), stops[self.rows[t] : self.rows[t + 1]], 0, len(self.of(t))) for t in range(len(self.names))]

    def of(self, t: int) -> np.ndarray:
        return self.words[self.rows[t] : self.rows[t + 1]]


def find(words: np.ndarray, rows: np.ndarray, index: Index, coverage: float, stops: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, template, matched words, first word, end word) of the matches in these texts, without overlaps."""
    keys, at = windows(words, rows, GRAM)
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))[at]
    mine = winnow(keys, at, row)
    place = index.find(keys[mine])
    hits: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for i in np.flatnonzero(place >= 0).tolist():
        word, r = int(at[mine[i]]), int(row[mine[i]])
        for j in range(index.first[place[i]], index.first[place[i] + 1]):
            hits[r, int(index.template[j])].append((word, word - int(index.place[j])))
    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    for (r, t), own in hits.items():
        template = index.of(t)
        n = len(template)
        pad = max(2, n // 5)
        own.sort(key=lambda x: (x[1], x[0]))
        group: list[tuple[int, int]] = []
        for x in [*own, None]:
            if group and (x is None or x[1] - group[-1][1] > pad):
                begins = [g[1] for g in group]
                lo, hi = max(int(rows[r]), begins[0] - pad), min(int(rows[r + 1]), begins[-1] + n + pad)
                width = pad + (begins[-1] - begins[0]) // 2 + 1
                got, a0, a1, b0, b1 = local_alignment(template, words[lo:hi], (begins[0] + begins[-1]) // 2 - lo, width)
                r0, r1 = int(rows[r]), int(rows[r + 1])
                if got >= coverage * n and Marks.agree(index.marks.of(words[r0:r1], stops[r0:r1], lo + b0 - r0, lo + b1 - r0, a0, n - a1), index.marked[t]):
                    found[r].append((got, t, lo + b0 - int(rows[r]), lo + b1 - int(rows[r])))
                group = []
            if x:
                group.append(x)
    out = []
    for r, own in found.items():
        taken: list[tuple[int, int]] = []
        for got, t, lo, hi in sorted(set(own), key=lambda x: (-x[0], x[0] / len(index.of(x[1])) * -1, x[1], x[2])):
            if all(hi <= a or lo >= b for a, b in taken):
                taken.append((lo, hi))
                out.append((r, t, got, lo, hi))
    return sorted(out)


def scan(docs: DataFrame, carry: list[str], text_col: str = "text", templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row for each match: ``carry``, license, matched_words, coverage, and its span in code points of the text."""
    slim = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for b in row_slices(batches, "_text"):
            data, offsets = text_bytes(pc.utf8_lower(b.column("_text")))
            s = spans(data, offsets, NOT_WORD)
            found = find(hashes(data, s.starts, s.ends), s.rows, index, coverage, dotted(data, s))
            if not found:
                continue
            raw, raw_at = text_bytes(b.column("_text"))
            own = spans(raw, raw_at, NOT_WORD)  # lower-casing moves no word border, so words count alike
            row, t, got, lo, hi = (np.array(x) for x in zip(*found, strict=True))
            point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            begin = point[own.starts[own.rows[row] + lo]] - point[raw_at[row]]
            end = point[own.ends[own.rows[row] + hi - 1]] - point[raw_at[row]]
            size = np.diff(index.rows)[t]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(b.column(i).take(at) for i in range(len(carry))), pa.array([index.names[i] for i in t], pa.string()), pa.array(got, pa.int64()),
                    pa.array(got / size), pa.array(begin, pa.int64()), pa.array(end, pa.int64()),
                ],
                names=[*(f"_c{i}" for i in range(len(carry))), "license", "matched_words", "coverage", "start", "end"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = ", ".join([f"_c{i} {kinds[f'_c{i}']}" for i in range(len(carry))] + ["license string, matched_words long, coverage double, start long, end long"])
    out = in_batches(slim, run, schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)], "license", "matched_words", "coverage", "start", "end")
