"""License scans: winnowed fingerprints of templates, then banded alignment of the candidates."""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from .common import map_batches, table, without

TOKEN = re.compile(r"[A-Za-z0-9]+")
#: Words of a fingerprint and fingerprints of a window at most: any shared run of WINDOW + GRAM - 1 words shares a fingerprint.
GRAM = 3
WINDOW = 2
#: Half the width of the alignment's band, in words, and the least coverage reported.
BAND = 8
MIN_COVERAGE = 0.8
#: Notices, opening clauses and full texts (less title and copyright line) of common licenses.
TEMPLATES = {
    "gpl-3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "bsd-3-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
}


def tokenize(text: str) -> tuple[list[str], list[int], list[int]]:
    words, starts, stops = [], [], []
    for m in TOKEN.finditer(text):
        words.append(m.group().lower())
        starts.append(m.start())
        stops.append(m.end())
    return words, starts, stops


def gram_hashes(words: list[str], gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of all runs of ``gram`` words; one of the whole text if it is shorter."""
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter((zlib.crc32(w.encode()) for w in words), dtype=np.uint64, count=len(words))
    size = min(gram, len(words))
    h = np.zeros(len(words) - size + 1, dtype=np.uint64)
    for i in range(size):
        h = (h ^ ids[i : len(ids) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window, the rightmost of equal ones."""
    n = len(hashes)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(hashes[::-1]))]) if n else np.zeros(0, dtype=np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    least = window - 1 - np.argmin(views[:, ::-1], axis=1)
    return np.unique(least + np.arange(n - window + 1))


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND, low: int = 0, high: int | None = None, reach: int = 0) -> tuple[int, int, int]:
    """(matched words, first, last) of the best alignment of the whole template with a stretch of ``words[low:high]`` near ``diagonal``; last exclusive.

    The band holds ``band`` diagonals on either side and ``reach`` further ones for words added to the text.
    """
    high = len(words) if high is None else high
    cells: dict[int, tuple[int, int, int, int]] = {}  # offset from the diagonal -> matched, -edits, -first, last
    start = {}
    for d in range(-band, band + reach + 1):
        start[d] = (0, 0, 0, 0)
    cells = start
    for i, word in enumerate(template):
        row = {}
        for d in range(-band, band + reach + 1):
            j = diagonal + i + d
            best = None
            if d in cells:
                matched, cost, first, last = cells[d]
                if low <= j < high and words[j] == word:
                    best = (matched + 1, cost, first if matched else -j, j + 1)
                else:
                    best = (matched, cost - 1, first, last)
            if d + 1 in cells:  # a template word that the text lacks
                matched, cost, first, last = cells[d + 1]
                if best is None or (matched, cost - 1) > best[:2]:
                    best = (matched, cost - 1, first, last)
            if d - 1 in row and row[d - 1] is not None:  # a further word in the text
                matched, cost, first, last = row[d - 1]
                if best is None or (matched, cost - 1) > best[:2]:
                    best = (matched, cost - 1, first, last)
            row[d] = best
        cells = {d: c for d, c in row.items() if c is not None}
    matched, _, first, last = max(cells.values(), key=lambda c: (c[0], c[1], c[2]))
    return matched, -first, last


def scheme(length: int, min_coverage: float) -> tuple[int, int]:
    """Gram and window for a template: at the least coverage, changed words leave a shared run of gram + window - 1 words."""
    kept = max(1, math.ceil(min_coverage * length - 1e-9))
    run = math.ceil(kept / (length - kept + 1))
    gram = min(GRAM, run)
    return gram, min(WINDOW, run - gram + 1)


@dataclass
class Index:
    """The inverted index of the templates' winnowed fingerprints, a (keys, places) for each (gram, window)."""

    names: list[str]
    words: list[list[str]]
    tables: dict[tuple[int, int], tuple[np.ndarray, list[list[tuple[int, int]]]]]
    vocabulary: dict[str, int]
    counts: list[tuple[np.ndarray, np.ndarray]]  # of each template: its words' numbers and how often each stands in it

    @classmethod
    def build(cls, templates: dict[str, str], min_coverage: float = MIN_COVERAGE) -> Index:
        names = sorted(n for n, t in templates.items() if TOKEN.search(t or ""))
        words = [tokenize(templates[n])[0] for n in names]
        places: dict[tuple[int, int], dict[int, list[tuple[int, int]]]] = {}
        for t, w in enumerate(words):
            gram, window = scheme(len(w), min_coverage)
            hashes = gram_hashes(w, gram)
            for at in winnow(hashes, window):
                places.setdefault((gram, window), {}).setdefault(int(hashes[at]), []).append((t, int(at)))
        vocabulary = {w: n for n, w in enumerate(sorted({x for ws in words for x in ws}))}
        counts = [np.unique([vocabulary[x] for x in ws], return_counts=True) for ws in words]
        return cls(names, words, {s: (np.array(sorted(p), dtype=np.uint64), [p[k] for k in sorted(p)]) for s, p in places.items()}, vocabulary, counts)

    def candidates(self, words: list[str]) -> list[tuple[int, int, int]]:
        """(position, template, offset) of all shared fingerprints, by position."""
        out = []
        for (gram, window), (keys, places) in self.tables.items():
            hashes = gram_hashes(words, gram)
            at = winnow(hashes, window)
            if len(at):
                key = np.searchsorted(keys, hashes[at])
                hit = (key < len(keys)) & (keys[np.minimum(key, len(keys) - 1)] == hashes[at])
                out += [(position, t, offset) for position, k in zip(at[hit].tolist(), key[hit].tolist(), strict=True) for t, offset in places[k]]
        return sorted(out)

    def _possible(self, t: int, ids: np.ndarray, diagonal: int, low: int, high: int, reach: int) -> int:
        """No alignment in the band matches more words than the template shares with the band's stretch of the text, order aside."""
        stretch = ids[max(low, diagonal - BAND) : max(0, min(high, diagonal + len(self.words[t]) + BAND + reach))]
        own, often = self.counts[t]
        return int(np.minimum(np.bincount(stretch, minlength=len(self.vocabulary) + 1)[own], often).sum())

    def _place(self, t: int, words: list[str], ids: np.ndarray, diagonal: int, low: int, high: int, needed: float, reaches: Callable[[], int]) -> tuple[int, int, int] | None:
        """The alignment near a diagonal that matches enough words: in the plain band or, if more match there, in one as wide as the later fingerprints have moved."""
        template, best = self.words[t], None
        if self._possible(t, ids, diagonal, low, high, 0) >= needed:
            best = align(template, words, diagonal, low=low, high=high)
        if best is None or best[0] < len(template):
            enough, wide = best is not None and best[0] >= needed, reaches()
            least = best[0] + 1 if enough else needed
            if wide > (BAND if enough else 0) and self._possible(t, ids, diagonal, low, high, wide) >= least:
                got = align(template, words, diagonal, low=low, high=high, reach=wide)
                best = got if got[0] >= least else best
        return best if best is not None and best[0] >= needed else None

    def scan(self, text: str | None, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, float, int, int]]:
        """(template, matched, words, coverage, start, end) of every place where a template is covered; a longer template's span hides those inside it."""
        if not text or not self.tables:
            return []
        words, starts, stops = tokenize(text)
        tried: set[tuple[int, int, int, int]] = set()
        spans: dict[int, list[tuple[int, int]]] = {}
        found = []
        hits = self.candidates(words)
        ids = np.fromiter((self.vocabulary.get(w, len(self.vocabulary)) for w in words), dtype=np.int64, count=len(words)) if hits else np.zeros(0, dtype=np.int64)
        places: dict[int, tuple[list[int], list[int]]] = {}
        for position, t, offset in hits:
            at, diagonals = places.setdefault(t, ([], []))
            at.append(position)
            diagonals.append(position - offset)
        numbered = {t: (np.array(at), np.array(diagonals)) for t, (at, diagonals) in places.items()}

        def reaches(t: int, position: int, diagonal: int) -> int:
            """How far later fingerprints of the template have moved right, by half its length at most; a next copy is further off."""
            at, diagonals = numbered[t]
            length = len(self.words[t])
            first, last = np.searchsorted(at, (position + 1, diagonal + length + length // 2))
            moved = diagonals[first:last] - diagonal
            # a fingerprint that stands further on in the text and in the template
            moved = moved[(moved > 0) & (moved <= length // 2) & (at[first:last] - position > moved)]
            return int(moved.max()) if len(moved) else 0

        for position, t, offset in hits:
            own = spans.setdefault(t, [])  # sorted, none overlapping: copies on either side bound the place of a further one
            while True:
                i = bisect.bisect_right(own, (position, len(words)))
                low, high = own[i - 1][1] if i else 0, own[i][0] if i < len(own) else len(words)
                if position < low:
                    break
                if (t, position - offset, low, high) in tried:
                    break
                tried.add((t, position - offset, low, high))
                place = self._place(t, words, ids, position - offset, low, high, min_coverage * len(self.words[t]), partial(reaches, t, position, position - offset))
                if place is None:
                    break
                matched, first, last = place
                bisect.insort(own, (first, last))
                found.append((matched, -len(self.words[t]), -first, last, t))
        out, taken = [], []  # taken: sorted spans, none overlapping
        for matched, length, first, last, t in sorted(found, reverse=True):
            i = bisect.bisect_left(taken, (-first, last))
            if (i and taken[i - 1][1] > -first) or (i < len(taken) and taken[i][0] < last):
                continue
            taken.insert(i, (-first, last))
            out.append((self.names[t], matched, -length, matched / -length, starts[-first], stops[last - 1]))
        return sorted(out, key=lambda r: r[4])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """All columns of ``docs`` and ``licenses``: an array of (template, matched, words, coverage, start, end).

    Spans are code points of the text, end exclusive; of overlapping matches
    the one with more matched words stays, then the shorter template. Null,
    empty and wordless texts have none; repeated rows give equal results;
    blank templates match nothing; words added to a notice are let pass up to
    half its length; an existing ``licenses`` is replaced; rows
    with a null id are scanned like others; texts of any length are scanned
    whole, spans in sorted lists, so that work grows with the matches.
    """
    index = Index.build(TEMPLATES if templates is None else templates, min_coverage)  # a list in code, not data
    docs = without(docs, "licenses")
    names = ("template", "matched", "words", "coverage", "start", "end")
    item = StructType.fromDDL("template string, matched int, words int, coverage double, start int, end int")
    arrow = pa.list_(pa.struct([("template", pa.string()), ("matched", pa.int32()), ("words", pa.int32()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[dict(zip(names, r, strict=True)) for r in index.scan(t, min_coverage)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, arrow)], [*batch.schema.names, "licenses"])

    return map_batches(docs, work, StructType([*docs.schema.fields]).add("licenses", ArrayType(item)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.*")
