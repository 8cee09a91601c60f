"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports what is matched and where.

Words are runs of letters and digits in lower case. Of each window of shingles the smallest hash is a fingerprint, for templates and texts alike, so that any
shared run of `k + window - 1` words shares a fingerprint. An inverted index of the templates' fingerprints (a fixed table that does not grow with the corpus)
gives the hits of a text; hits of one template on nearby diagonals are one candidate, which a local alignment inside a band around them confirms.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streetworth.llm import _text as T
from streetworth.llm.suffix_dedup import sliding_min

#: Fixed texts: public license texts and notices, and short statements as they are written into files and pages.
TEMPLATES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE
FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT (grant)": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.""",
    "MIT (statement)": "Released under the MIT License.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of
the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License.""",
    "Apache-2.0 (statement)": "Licensed under the Apache License, Version 2.0.",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program.""",
    "GPL-3.0 (statement)": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free
Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD (conditions)": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "BSD-3-Clause (third condition)": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
this software without specific prior written permission.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at http://mozilla.org/MPL/2.0/.""",
    "EPL-2.0": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    "ISC (grant)": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product,
an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented
as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)""",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Unlicense (statement)": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.
This software is distributed without any warranty.""",
    "CC-BY-NC-4.0 (statement)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (statement)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All rights reserved": "Copyright. All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
}

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = T.spans_of(_WORD[data], offsets)
    return starts, ends, T.hash_ranges(T.LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def winnow(hashes: np.ndarray, begins: np.ndarray, window: int) -> np.ndarray:
    """Positions of the fingerprints: of each window of one text's hashes (of the whole where it has fewer), the smallest, the leftmost of equals."""
    n = len(hashes)
    place = np.uint64((1 << 32) - 1)
    order = (hashes & ~place) | np.arange(n, dtype=np.uint64)
    sizes = np.diff(begins)
    least = (sliding_min(order, window) & place).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = text[: len(least)] == text[window - 1 :] if len(least) else np.zeros(0, bool)
    short = [begins[i] + int(np.argmin(order[begins[i] : begins[i + 1]])) for i in np.flatnonzero((sizes > 0) & (sizes < window))]
    return np.unique(np.concatenate((least[inside], np.array(short, np.int64))))


def align(template: np.ndarray, words: np.ndarray, begin: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """Local alignments (equal 2, else -1) of a template with many stretches words[begin:begin + size], text position - template position being in low..high.

    For each stretch: equal words, first and last + 1 text word of the best alignment. One template word a step, all stretches and diagonals at once; gaps along the
    text are the running maximum of score + diagonal.
    """
    g, d = len(begin), np.arange(int((high - low).max()) + 1)
    score, equal, first = np.zeros((g, len(d) + 1), np.int64), np.zeros((g, len(d) + 1), np.int64), np.full((g, len(d) + 1), -1)
    best, found = np.zeros(g, np.int64), np.zeros((3, g), np.int64)
    everyone = np.arange(g)
    for i, word in enumerate(template):
        j = i + low[:, None] + d
        there = (d <= (high - low)[:, None]) & (j >= 0) & (j < size[:, None])
        hit = there & (words[np.clip(begin[:, None] + j, 0, len(words) - 1)] == word)
        s, e = score[:, :-1] + np.where(hit, 2, -1), equal[:, :-1] + hit
        f = np.where(hit & (first[:, :-1] < 0), j, first[:, :-1])
        up = score[:, 1:] - 1 > s
        s, e, f = np.where(up, score[:, 1:] - 1, s), np.where(up, equal[:, 1:], e), np.where(up, first[:, 1:], f)
        alive = there & (s > 0)
        s, e, f = np.where(alive, s, 0), np.where(alive, e, 0), np.where(alive, f, -1)
        run = np.maximum.accumulate(s + d, axis=1)
        source = np.maximum.accumulate(np.where(s + d == run, d, 0), axis=1)
        s, e, f = run - d, np.take_along_axis(e, source, 1), np.take_along_axis(f, source, 1)
        alive = there & (s > 0)
        score[:, :-1], equal[:, :-1], first[:, :-1] = np.where(alive, s, 0), np.where(alive, e, 0), np.where(alive, f, -1)
        top = score[:, :-1].argmax(1)
        now = score[everyone, top]
        better = np.flatnonzero(now > best)
        best[better] = now[better]
        found[:, better] = equal[better, top[better]], first[better, top[better]], j[better, top[better]] + 1
    return found[0], found[1], found[2]


class Index:
    """Templates as word hashes, and their fingerprints in order with the template and the word where each stands."""

    def __init__(self, templates: dict[str, str], k: int, window: int):
        self.names, self.k, self.window = list(templates), k, window
        self.words, prints = [], []
        for t, text in enumerate(templates.values()):
            data = np.frombuffer(text.encode(), np.uint8)
            _, _, hashes, firsts = _words(data, np.array([0, len(data)]))
            self.words.append(hashes)
            shingles, begins = T.shingles(hashes, firsts, k)
            prints += [(int(shingles[p]), t, int(p)) for p in winnow(shingles, begins, window)]
        prints.sort()
        self.keys = np.array([p[0] for p in prints], np.uint64)
        self.template, self.place = np.array([p[1] for p in prints]), np.array([p[2] for p in prints])


def _best(found: list[tuple]) -> list[tuple]:
    """Of matches (row, template, equal, words, start, end) that overlap in a row, the one with more equal words, then the larger share of its template."""
    kept: list[tuple] = []
    for m in sorted(set(found), key=lambda m: (m[0], -m[2], -m[2] / m[3], m[1], m[4])):
        own = itertools.takewhile(lambda o: o[0] == m[0], reversed(kept))  # noqa: B023
        if not any(o[4] < m[5] and m[4] < o[5] for o in own):
            kept.append(m)
    return kept


def _scan(shared, band: int, coverage: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for rows, data, offsets in T.slices(batches):
            starts, ends, hashes, firsts = _words(data, offsets)
            shingles, begins = T.shingles(hashes, firsts, index.k)
            at = winnow(shingles, begins, index.window)
            at = at[np.isin(shingles[at], index.keys)]
            low, high = np.searchsorted(index.keys, shingles[at]), np.searchsorted(index.keys, shingles[at], "right")
            text = np.searchsorted(begins, at, "right") - 1
            hits = sorted((int(d), int(index.template[p]), int(x - begins[d]) - int(index.place[p]), int(x - begins[d])) for x, d, a, b in zip(at, text, low, high, strict=True) for p in range(a, b))
            bands = [min(band, (len(w) - 1) // 2) for w in index.words]  # two copies of a short template stay apart
            groups: list[list[tuple]] = []
            for h in hits:
                if groups and groups[-1][-1][:2] == h[:2] and h[2] - groups[-1][-1][2] <= bands[h[1]]:
                    groups[-1].append(h)
                else:
                    groups.append([h])
            ids, out = rows.column(0).to_pylist(), []
            by: dict[int, list[tuple]] = {}
            for g in groups:
                by.setdefault(g[0][1], []).append((g[0][0], g[0][2], g[-1][2]))
            for t, own in by.items():
                template, doc, near, far = index.words[t], *np.array(own, np.int64).T
                begin = np.maximum(0, near - bands[t])
                size = np.minimum(firsts[doc + 1] - firsts[doc], far + len(template) + bands[t]) - begin
                begin_at = firsts[doc] + begin
                equal, first, last = align(template, hashes, begin_at, size, near - bands[t] - begin, far + bands[t] - begin)
                for i in np.flatnonzero(equal >= max(coverage * len(template), min(least, len(template)))).tolist():
                    at, from_, to = int(offsets[doc[i]]), int(starts[begin_at[i] + first[i]]), int(ends[begin_at[i] + last[i] - 1])
                    chars = [int(((data[a:b] & 0xC0) != 0x80).sum()) for a, b in ((at, from_), (from_, to))]
                    out.append((int(doc[i]), index.names[t], int(equal[i]), len(template), chars[0], sum(chars)))
            out = [(ids[m[0]], *m[1:]) for m in _best(out)]
            types = {"doc_id": pa.int64(), "license": pa.string(), "matched": pa.int64(), "words": pa.int64(), "start": pa.int64(), "end": pa.int64()}
            yield pa.record_batch({c: pa.array([o[i] for o in out], x) for i, (c, x) in enumerate(types.items())})

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, k: int = 3, window: int = 2, band: int = 8, coverage: float = 0.75, least: int = 4) -> DataFrame:
    """One row for each template found in a text: doc_id, license, matched (equal words), coverage (of the template's words), start, end (code points).

    A match needs `coverage` of the template's words in one alignment that strays at most `band` words; a template may be found more than once in a text.
    Null and empty texts give none; repeated rows give repeated results; other columns are not read. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, k, window))
    found = docs.select("doc_id", "text").mapInArrow(_scan(shared, band, coverage, least), "doc_id long, license string, matched long, words long, start long, end long")
    return found.select("doc_id", "license", "matched", F.round(F.col("matched") / F.col("words"), 4).alias("coverage"), "start", "end")
