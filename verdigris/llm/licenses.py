"""License scans: MinHash bands over overlapping windows retrieve templates; containment verifies them.

A template is the set of its five-word shingles. A document is read in windows as long as each
template, overlapping by seven eighths, so one of them lies within a sixteenth of a template's
length of any place where it stands; windows at a document's end have what is left of it, and none goes on
in the next document, so results don't depend on how rows fall into batches. The minima of sixteen hash functions over a window's shingles
come from tables of minima over runs of 1, 2, 4 ... shingles, and each is a band of its own. A minimum
agrees with a template's with the Jaccard similarity of the two as probability: a window that is as long,
shares 0.8 of its shingles and is off by a sixteenth has (0.8 - 1/16) / (2 - 0.8 + 1/16) = 0.584, and some
band agrees with probability 1 - (1 - 0.584)^16 > 0.999999; at a Jaccard of 0.4 it is still 0.9997. Where a band agrees, the template's exact
shingles are counted in the window and a stride on either side; 0.8 of them make a match.

Defined results: null, empty and short texts have no rows; repeated rows are scanned each, so their
rows repeat; long texts are read whole; extra columns are ignored; without templates or documents the
result is empty. A template of fewer than five words is one shingle of all of them, and looked up exactly;
one without words is never found.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import TokenCache

SHINGLE = 5
LEAST = 0.8
HASHES, BAND = 16, 1
WORDS_AT_ONCE = 1 << 14
FIRST_BITS = np.uint64(48)
NONE = np.uint64((1 << 64) - 1)
WORD = re.compile(r"[^\W_]+")

#: Short forms of public licences' notices, as they stand in texts and sources, and whole texts
#: of the shorter licences (without the lines of their holders).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 or later notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "BSD grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "Licensed under the Creative Commons Attribution-ShareAlike License.",
    "MIT text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense notice": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(found: list[str]) -> set[tuple[str, ...]]:
    n = min(SHINGLE, len(found))
    return {tuple(found[i : i + n]) for i in range(len(found) - n + 1)} if n else set()


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers over all 64-bit integers (a one-to-one mixing of bits)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    raw = word.encode("utf-8", "surrogatepass")
    return zlib.crc32(raw) << 32 | zlib.crc32(raw, 0x5EED)


SALTS = mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACES = mixed(np.arange(101, 101 + SHINGLE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    n = max(0, len(hashes) - SHINGLE + 1)
    total = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        total += mixed(hashes[k : k + n]) * PLACES[k]
    return mixed(total)


class Scanner:
    """Templates' bands, and the scan of whole documents against them."""

    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.sets = [shingles(words(templates[n])) for n in self.names]
        self.cache = TokenCache(word_hash)
        self.lengths: dict[int, list[int]] = {}
        self.short: list[tuple[int, list[str], np.ndarray]] = []
        for t, name in enumerate(self.names):
            if 0 < len(found := words(templates[name])) < SHINGLE:
                self.short.append((t, found, self.hash(found)))
            elif found:
                self.lengths.setdefault(len(found) - SHINGLE + 1, []).append(t)
        #: What follows a document: as many empty places as the longest window takes from its last word.
        self.room = max(self.lengths, default=0) + SHINGLE
        self.bands = {}
        for m, members in self.lengths.items():
            keys = np.concatenate([self.keys(self.minima(self.hash(words(templates[self.names[t]])), {m: np.zeros(1, int)})[m]) for t in members])
            flat, owner = keys.ravel(), np.repeat(members, keys.shape[1])
            order = np.argsort(flat, kind="stable")
            some = np.zeros(1 << 16, bool)
            some[flat >> FIRST_BITS] = True  # most windows' keys are told apart by their first bits
            self.bands[m] = some, flat[order], owner[order]

    def hash(self, found: list[str]) -> np.ndarray:
        return np.fromiter(map(self.cache.__getitem__, found), np.uint64, len(found))

    def minima(self, hashes: np.ndarray, starts: dict[int, np.ndarray], left: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """For each window length m (in shingles), the HASHES minima of the windows at ``starts[m]``. With
        ``left``, the words from each place to its document's end, shingles beyond an end count for nothing."""
        base = shingle_hashes(hashes)
        run, size, out = mixed(base[:, None] ^ SALTS), 1, {}
        if left is not None:
            run[left[: len(base)] < SHINGLE] = NONE
        for m in sorted(starts):
            while 2 * size <= m and len(run) > size:
                run, size = np.minimum(run[:-size], run[size:]), 2 * size
            if len(base) >= m:
                at = starts[m][starts[m] <= len(base) - m]
                out[m] = np.minimum(run[at], run[at + m - size])
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """One key for each band; bands differ."""
        keys = minima[:, 0::BAND] * PLACES[0]
        for k in range(1, BAND):
            keys += minima[:, k::BAND] * PLACES[k]
        keys += SALTS[: HASHES // BAND]
        return keys

    def candidates(self, hashes: np.ndarray, at: np.ndarray, left: np.ndarray) -> set[tuple[int, int, int]]:
        """(start, windows' length in shingles, template) where a band agrees; ``at``: each place's number
        in its document."""
        found = set()
        inside = np.flatnonzero(left >= SHINGLE)
        starts_of = {m: inside[at[inside] % max(1, m // 8) == 0] for m in self.lengths}
        for m, minima in self.minima(hashes, starts_of, left).items():
            starts, (some, known, owner) = starts_of[m], self.bands[m]
            keys = self.keys(minima)
            window, band = np.nonzero(some[keys >> FIRST_BITS])
            key = keys[window, band]
            low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
            for k in np.flatnonzero(low < high):
                found |= {(int(starts[window[k]]), m, int(t)) for t in owner[low[k] : high[k]]}
        return found

    def scan(self, docs: list[list[str]]) -> list[tuple[int, str, float, int, int]]:
        """(document, template, containment, first word, places) for each match."""
        out, best = [], {}
        lengths = np.array([len(d) for d in docs], int)
        places = lengths + np.where(lengths >= SHINGLE, self.room, 0)
        first = np.cumsum(places) - places
        in_doc = np.arange(places.sum()) - np.repeat(first, places)
        left = np.repeat(lengths, places) - in_doc
        hashes = np.zeros(len(left), np.uint64)
        hashes[left > 0] = self.hash([w for d in docs for w in d])
        for start, m, t in sorted(self.candidates(hashes, in_doc, left)):
            d = int(np.searchsorted(first, start, "right")) - 1
            at = int(in_doc[start])
            step = max(1, m // 8)
            from_word, to_word = max(0, at - step), at + m + SHINGLE - 1 + step
            share = len(self.sets[t] & shingles(docs[d][from_word:to_word])) / len(self.sets[t])
            if share >= LEAST:
                seen = best.setdefault((d, t), [])
                if seen and from_word < seen[-1][1]:  # the same place, seen from another window
                    seen[-1] = (min(seen[-1][0], from_word), to_word, max(seen[-1][2], share))
                else:
                    seen.append((from_word, to_word, share))
        for t, template, known in self.short:
            n = len(known)
            same = np.ones(max(0, len(hashes) - n + 1), bool)
            for k in range(n):
                same &= hashes[k : len(hashes) - n + 1 + k] == known[k]
            for start in np.flatnonzero(same & (left[: len(same)] >= n)).tolist():
                d, at = int(np.searchsorted(first, start, "right")) - 1, int(in_doc[start])
                seen = best.setdefault((d, t), [])
                if docs[d][at : at + n] == template and not (seen and at < seen[-1][1]):
                    seen.append((at, at + n, 1.0))
        for (d, t), seen in best.items():
            if not seen:
                continue
            out.append((d, self.names[t], max(p[2] for p in seen), seen[0][0], len(seen)))
        return sorted(out)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(doc_id, license, containment, first_word, places): a row for each template found in a document.
    ``first_word`` is at most a stride before the first match; ``places`` counts separate ones."""

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for batch in batches:
            ids, chunk, size, out = batch["doc_id"].tolist(), [], 0, []

            def flush(upto: int) -> None:
                first = upto - len(chunk)
                out.extend((ids[first + d], *rest) for d, *rest in scanner.scan(chunk))

            for k, text in enumerate(batch["text"], 1):
                found = words(text)
                chunk.append(found)
                size += len(found) + scanner.room
                if size >= WORDS_AT_ONCE or k == len(ids):
                    flush(k)
                    chunk, size = [], 0
            yield pd.DataFrame(out, columns=["doc_id", "license", "containment", "first_word", "places"])

    # through text: pandas has no integers beside nulls
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = narrow.mapInPandas(scanned, "doc_id string, license string, containment double, first_word int, places int")
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))
