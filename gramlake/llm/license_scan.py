"""License scans (operator 1): which license texts and notices a document holds, how much of each, and where.

Templates are winnowed: of every WINDOW consecutive word k-grams the least hash is a fingerprint, and an inverted index maps
a fingerprint to its templates and positions. A document's k-grams are looked up in it; hits of one template whose diagonals
(document position minus template position) lie within the band make a candidate. A banded alignment of the template with the
document's words around the candidate, whose band follows the hits of a long template, gives the matched words: their share is the coverage, the first and last the span;
every further match of the band that shares no word with it is one too.
"""

from __future__ import annotations

import bisect
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import FOLD

K, WINDOW, BAND, COVERAGE = 3, 4, 24, 0.75
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
RESULT = "doc_id long, license string, coverage double, matched long, start long, end long"

# Short licenses and notices as their publishers give them; longer licenses lie in the folder licenses.
TEMPLATES = {
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "isc": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org/>",
}


# How licenses are called.
NAMES = {
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL 3.0"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "artistic-2.0": ["Artistic License 2.0"],
    "bsd-2-clause": ["BSD 2-Clause License", "simplified BSD license"],
    "bsd-3-clause": ["BSD 3-Clause License", "new BSD license", "modified BSD license"],
    "bsl-1.0": ["Boost Software License, Version 1.0"],
    "cc-by-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nc-sa-4.0": ["CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "cc-by-nd-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-sa-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cddl-1.0": ["Common Development and Distribution License, Version 1.0"],
    "epl-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL 2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL 3.0"],
    "isc": ["ISC License"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3"],
    "mit": ["MIT License", "Expat License"],
    "mpl-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "zlib": ["zlib License"],
}
LEADS = ("under", "under the", "under a", "under an")


def references() -> list[tuple[str, str]]:
    """(name-reference, words) for each way to say that something is under a license, whatever verb stands before it."""
    return [(f"{name}-reference", f"{lead} {called}") for name, ways in NAMES.items() for called in ways for lead in LEADS]


def known_licenses() -> list[tuple[str, str]]:
    """(name, text) of all templates: the whole licenses, the notices and the references."""
    folder = os.path.join(os.path.dirname(__file__), "licenses")
    whole = []
    for file in sorted(os.listdir(folder)):
        with open(os.path.join(folder, file), encoding="utf-8") as f:
            whole.append((file.removesuffix(".txt"), f.read()))
    return [*whole, *TEMPLATES.items(), *references()]


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


WORDS = WordHash()


def kgrams(words: list[bytes]) -> np.ndarray:
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    if len(h) < K:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - K + 1, np.uint64)
    for i in range(K):
        out = (out ^ h[i : len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def winnow(grams: np.ndarray) -> dict[int, int]:
    """position -> fingerprint: the least of each WINDOW consecutive k-grams, the rightmost of equals."""
    out = {}
    for k in range(max(1, len(grams) - WINDOW + 1)):
        part = grams[k : k + WINDOW]
        if len(part):
            at = k + len(part) - 1 - int(np.argmin(part[::-1]))
            out[at] = int(grams[at])
    return out


class TemplateIndex:
    """Several templates may share a name."""

    def __init__(self, templates: list[tuple[str, str]] | dict[str, str]):
        pairs = sorted(set(templates.items() if isinstance(templates, dict) else templates))
        self.names, texts = [n for n, _ in pairs], [t for _, t in pairs]
        self.words = [t.encode().translate(FOLD).split() for t in texts]
        number: dict[bytes, int] = {}
        self.codes = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in self.words]
        self.number = number
        entries = sorted((f, t, p) for t, w in enumerate(self.words) for p, f in winnow(kgrams(w)).items())
        self.prints = np.array([e[0] for e in entries], np.uint64)
        self.template = np.array([e[1] for e in entries], np.int64)
        self.position = np.array([e[2] for e in entries], np.int64)
        self.n_prints = np.bincount(self.template, minlength=len(self.names))
        self.known = np.unique(self.prints)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) in order of start; offsets are characters of the text.

        A match within the span of a longer one is left out. Null and empty texts have none."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        flat = raw.translate(FOLD)
        words = flat.split()
        grams = kgrams(words)
        if not len(grams):
            return []
        at = np.searchsorted(self.known, grams)
        at[at == len(self.known)] = 0
        where = np.flatnonzero(self.known[at] == grams)
        if not len(where):
            return []
        lo, hi = np.searchsorted(self.prints, grams[where]), np.searchsorted(self.prints, grams[where], side="right")
        entry = np.concatenate([np.arange(a, b) for a, b in zip(lo, hi, strict=True)])
        pos = np.repeat(where, hi - lo)
        template, diagonal = self.template[entry], pos - self.position[entry]
        codes = np.fromiter((self.number.get(w, -1) for w in words), np.int64, len(words))
        order = np.lexsort((pos, diagonal, template))
        found = []
        t, d, p = template[order], diagonal[order], pos[order]
        cuts = np.flatnonzero((t[1:] != t[:-1]) | (d[1:] - d[:-1] > BAND)) + 1
        for group in np.split(np.arange(len(t)), cuts):
            name = int(t[group[0]])
            if len(np.unique(p[group])) * 4 < self.n_prints[name]:  # a quarter of the fingerprints at least
                continue
            if len(self.words[name]) > 4 * BAND:  # occurrences of a long one are far apart: the group is one, whose diagonal drifts
                centres = self._centres(p[group] - d[group], d[group], len(self.words[name]))
                found += self._matches(codes, name, centres, False)
            else:
                for first in self._starts(d[group]):
                    found += self._matches(codes, name, np.full(len(self.words[name]), first), True)
        found = self._apart(found)
        found.sort(key=lambda m: (m[1] - m[2], m[1], -m[0] / len(self.words[m[3]]), m[3]))
        kept: list[tuple[int, int, int, int]] = []
        for m in found:
            if not any(a <= m[1] and m[2] <= b for _, a, b, _ in kept):
                kept.append(m)
        if not kept:
            return []
        spans = [m.span() for m in WORD.finditer(flat)]
        char = lambda k: len(raw[:k].decode("utf-8", "surrogatepass"))
        return sorted(((self.names[t], n / len(self.words[t]), n, char(spans[a][0]), char(spans[b][1])) for n, a, b, t in kept), key=lambda x: (x[3], x[4], x[0]))

    @staticmethod
    def _starts(diagonals: np.ndarray) -> list[int]:
        """The diagonals to align on: one for each stretch of BAND."""
        out: list[int] = []
        for d in np.unique(diagonals).tolist():
            if not out or d - out[-1] > BAND // 2:
                out.append(d)
        return out

    @staticmethod
    def _centres(at: np.ndarray, diagonals: np.ndarray, n: int) -> np.ndarray:
        """The diagonal for each template word: a running median of the hits in their order; hits of places that are met only
        once, on both sides, go before those of repeated phrases."""
        _, back, times = np.unique(at, return_inverse=True, return_counts=True)
        _, back2, times2 = np.unique(at + diagonals, return_inverse=True, return_counts=True)
        once = (times[back] == 1) & (times2[back2] == 1)
        if once.sum() * 4 >= len(times):
            at, diagonals = at[once], diagonals[once]
        order = np.lexsort((diagonals, at))
        at, d = at[order], diagonals[order]
        wide = np.pad(d, 4, mode="edge")
        return np.rint(np.interp(np.arange(n), at, np.median(np.lib.stride_tricks.sliding_window_view(wide, 9), axis=1))).astype(np.int64)

    def _matches(self, words: np.ndarray, name: int, centres: np.ndarray, several: bool) -> list[tuple[int, int, int, int]]:
        """All matches (matched words, first, last, template) of the band that share no word: the best one, then, if several may
        stand close together, those of the words before and after it."""
        n, out = len(centres), []
        gaps = [(max(0, int(centres.min()) - BAND), min(len(words), int(centres.max()) + n + BAND))]
        while gaps:
            lo, hi = gaps.pop()
            if hi - lo < COVERAGE * n:
                continue
            m = self.align(words, name, centres, lo, hi)
            if m and m[0] >= COVERAGE * n:
                out.append((*m, name))
                gaps += [(lo, m[1]), (m[2] + 1, hi)] * several
        return out

    @staticmethod
    def _apart(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Of one template's matches that overlap (bands overlap too) the one with most matched words, then the shortest."""
        kept: dict[int, list[tuple[int, int]]] = {}
        out = []
        for m in sorted(set(found), key=lambda m: (m[3], -m[0], m[2] - m[1], m[1])):
            spans = kept.setdefault(m[3], [])
            k = bisect.bisect_right(spans, (m[2], m[2]))  # those that start at its last word or before
            if not k or spans[k - 1][1] < m[1]:
                bisect.insort(spans, (m[1], m[2]))
                out.append(m)
        return out

    def align(self, words: np.ndarray, name: int, centres: np.ndarray, lo: int, hi: int) -> tuple[int, int, int] | None:
        """(matched words, first and last matched word): the longest common subsequence within the band of each template word's
        diagonal and the document's words (as numbers) from lo to before hi; of equals the shortest span, then the last one."""
        t, width = self.codes[name], 2 * BAND + 1
        starts = np.arange(len(t)) + centres - BAND  # the document word of each row's first cell
        origin = int(starts.min())
        place = np.arange(origin, int(starts.max()) + width)
        band = np.where((place >= lo) & (place < hi), words[np.clip(place, 0, len(words) - 1)], -2)
        equal = np.lib.stride_tricks.sliding_window_view(band, width)[starts - origin] == t[:, None]
        moves = np.diff(starts, prepend=starts[:1] - 1).tolist()
        # A cell is one number: matched words, then the span (less is more), then the first matched word, counted from the band's.
        top = (1 << 22) - 1
        best = np.zeros(width, np.int64)
        for row, move in enumerate(moves):
            # above[j + 1] is the former row at this cell's document word, above[j] at the one before.
            above = np.empty(width + 1, np.int64)
            a, b = max(0, 1 - move), min(width + 1, width + 1 - move)
            if a < b:
                above[a:b] = best[a + move - 1 : b + move - 1]
                above[b:] = best[-1]
                above[:a] = 0
            else:
                above[:] = best[-1] if move > 0 else 0
            new = np.maximum(above[1:], above[:-1])
            j = np.flatnonzero(equal[row])
            if len(j):
                k, old = int(starts[row]) - origin + j, above[j]
                first = np.where(old > 0, old & top, k)
                new[j] = np.maximum(new[j], ((old >> 44) + 1) << 44 | (top - (k - first)) << 22 | first)
            best = np.maximum.accumulate(new)
        found = int(best.max())
        if not found:
            return None
        first, span = found & top, top - (found >> 22 & top)
        return found >> 44, first + origin, first + span + origin


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, license, coverage, matched, start, end. Repeated rows give repeated matches; documents
    without a match (null and empty ones among them) give none, nor does an empty table; other columns are left out, whatever
    their names. Whole texts are read, however long; of templates that match the same words the longer one is told, of equal
    spans the first by name. The templates are part of the program, so their index has a fixed size."""
    texts, made = templates or known_licenses(), []

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(TemplateIndex(texts))
        for b in batches:
            out = [(i, *m) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in made[0].scan(t)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(rows, RESULT)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
