"""Licence scans: parts of a text compared with licence templates by the Dice coefficient.

A text is normalised to lower-cased (A-Z) words of letters, digits and everything beyond
ASCII. Its parts are all windows of consecutive words, across lines too; runs of whole lines
are among them. A part matches a template if the Dice coefficient of their bags of word
bigrams, 2 * |common| / (|part| + |template|), is at least ``SIMILARITY``.

Sizes prune: a template with t bigrams can only match parts of t * s / (2 - s) to
t * (2 - s) / s bigrams, with t * s / (2 - s) or more in common, so texts without that many are
not compared. The best part starts and ends with a bigram of the template (without another one
at its edge it scores higher), so only such windows are. These bounds drop nothing that could
match. The templates are few and fixed in number, so they travel with the tasks; there is no
shuffle.

The templates: notices, single lines and short licences (``TEMPLATES``), and the full texts in
``license_texts`` (Apache-2.0, CC0-1.0, GPL-2.0, GPL-3.0, LGPL-2.1, LGPL-3.0, MPL-2.0). The full
texts of AGPL-3.0 and EPL-2.0 are not among them, their notices are.

Where windows of several templates overlap, the nearest one takes its words (the higher
coefficient, then the longer window) and the words around it are searched anew, so two templates
are both found on disjoint windows only.

Null and empty texts and texts of one word have no licence. Of several parts that match a
template the best counts, then the earliest, then the shortest; templates tie by name.
Repeated documents are scanned each on its own.
"""

from __future__ import annotations

import pkgutil
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterbook.llm.common import slices, utf8

SIMILARITY = 0.8

#: Licence texts and the usual notices that name a licence.
TEMPLATES = {
    "AGPL-3.0 (line)": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 (notice)": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-2-Clause (line)": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "BSD-3-Clause (line)": "Licensed under the BSD 3-Clause License.",
    "CC-BY-3.0 (notice)": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-4.0 (line)": "Licensed under CC BY 4.0.",
    "CC-BY-4.0 (notice)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0 (line)": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-ND-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0 (line)": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0 (line)": "Licensed under CC BY-ND 4.0.",
    "CC-BY-ND-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-SA-3.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-SA-4.0 (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0 (notice)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0 (line)": "Licensed under CC0 1.0 Universal.",
    "CC0-1.0 (notice)": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0 (line)": "Licensed under the Eclipse Public License, version 2.0.",
    "EPL-2.0 (notice)": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "GPL-2.0 (line)": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0 (notice)": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 (notice)": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "LGPL-2.1 (line)": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1 (notice)": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "LGPL-3.0 (line)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0 (notice)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT (line)": "Released under the MIT License.",
    "MPL-2.0 (line)": "Licensed under the Mozilla Public License, version 2.0.",
    "MPL-2.0 (notice)": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}

#: Licences whose full texts are files of ``license_texts``.
FULL_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")


@lru_cache(maxsize=1)
def all_templates() -> dict[str, str]:
    """``TEMPLATES`` and the full texts."""
    return TEMPLATES | {name: pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode() for name in FULL_TEXTS}


_WORD_BYTES = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x0A if c == 0x0A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class Templates:
    """The bigram bags of the templates and their bounds."""

    def __init__(self, templates: dict[str, str], similarity: float):
        self.similarity = similarity
        self.bags: dict[str, Counter] = {}
        self.known: dict[tuple[bytes, bytes], int] = {}
        for name, text in sorted(templates.items()):
            listed = words(text.encode())
            pairs = [self.known.setdefault(p, len(self.known)) for p in zip(listed, listed[1:], strict=False)]
            self.bags[name] = Counter(pairs)
        s = similarity
        self.sizes = {name: bag.total() for name, bag in self.bags.items()}
        # a little wider than exact: rounding must not drop a part that just matches
        self.low = {name: n * s / (2 - s) - 1e-9 for name, n in self.sizes.items()}
        self.high = {name: n * (2 - s) / s + 1e-9 for name, n in self.sizes.items()}
        self.longest = max(self.high.values(), default=0)
        #: How often each bigram (rows) stands in each template (columns).
        self.caps = np.zeros((len(self.known), len(self.bags)), np.int32)
        for k, bag in enumerate(self.bags.values()):
            self.caps[list(bag), k] = list(bag.values())

    def dice(self, part: list[int], name: str) -> float:
        """The coefficient of a part (its bigrams, -1 where no template has them) and a template."""
        common = Counter(p for p in part if p >= 0) & self.bags[name]
        return 2 * common.total() / (len(part) + self.sizes[name])

    def _read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the templates' bigrams, which they are, and how many words end each line."""
        lines = [x.split() for x in text.translate(_WORD_BYTES).split(b"\n")]
        flat = [w for x in lines for w in x]
        known = self.known.get
        pairs = np.array([known(p, -1) for p in zip(flat, flat[1:], strict=False)], np.int64)
        at = np.flatnonzero(pairs >= 0)
        return at, pairs[at], np.cumsum([len(x) for x in lines])

    def find(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first line, past the last) of the best window of words for
        each template that some window matches."""
        at, pairs, ends = self._read(text)
        return _in_lines(self._windows(at, pairs), ends)

    def nearest(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """As :meth:`find`, but every word counts for one template only: the best window goes first
        (by coefficient, then length, place and name), the words before and after it are then
        searched anew. Of several windows of a template the best is returned."""
        at, pairs, ends = self._read(text)
        best: dict[str, tuple[float, int, int]] = {}
        parts = [(0, len(at))]
        while parts:
            a, b = parts.pop()
            windows = self._windows(at[a:b], pairs[a:b])
            if not windows:
                continue
            name, score, first, last = min(windows, key=lambda x: (-x[1], x[2] - x[3], x[2], x[0]))
            best[name] = min(best.get(name, (0.0, 0, 0)), (-score, first, last))
            parts.append((a, a + int(np.searchsorted(at[a:b], first - 1))))
            parts.append((a + int(np.searchsorted(at[a:b], last + 1)), b))
        return _in_lines([(name, -score, first, last) for name, (score, first, last) in sorted(best.items())], ends)

    def _windows(self, at: np.ndarray, pairs: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coefficient, first word, last word) of the best window for each template."""
        distinct, counts = np.unique(pairs, return_counts=True)
        shared = np.minimum(counts[:, None], self.caps[distinct]).sum(axis=0).tolist()
        out = []
        for k, name in enumerate(self.bags):
            if shared[k] and shared[k] >= self.low[name]:
                score, first, last = self._best(at, pairs, k, name)
                if score >= self.similarity:
                    out.append((name, score, first, last))
        return out

    def _best(self, at: np.ndarray, pairs: np.ndarray, k: int, name: str) -> tuple[float, int, int]:
        """The best coefficient of a window, its first and its last word.

        A window that starts d words later than another, and ends where it does, has no more bigrams
        in common, so its coefficient is at most 1 + d / (template + part) times as high: starts
        that cannot pass what is found, or the similarity, are stepped over."""
        s, n = self.similarity, self.sizes[name]
        mine = self.caps[pairs, k] > 0
        at, caps = at[mine], self.caps[pairs[mine], k]
        codes = np.unique(pairs[mine], return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes)
        nth = np.empty(len(codes), np.int64)  # how often a bigram has occurred before
        nth[order] = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        far = np.searchsorted(at, at + self.high[name] - 1, side="right")
        step = n // 8  # words stepped over at most; windows are looked at so much farther
        farther = np.searchsorted(at, at + self.high[name] - 1 + step, side="right")
        here = np.arange(len(at))
        # with all of its bigrams in common, no window from here on would reach the coefficient
        most = np.maximum.accumulate((2 * (here + 1) - s * (at + 1))[::-1])[::-1]
        some = np.flatnonzero((far - here >= self.low[name]) & (most - (2 * here - s * at) >= s * n - 1e-6))
        best, passed, before, go_on = (0.0, 0, 0), 0, np.zeros(len(sizes), np.int64), 0.0
        for a in some.tolist():
            if at[a] < go_on:
                continue
            before += np.bincount(codes[passed:a], minlength=len(sizes))
            passed, b = a, int(farther[a])
            common = np.cumsum(nth[a:b] - before[codes[a:b]] < caps[a:b])
            score = 2 * common / (at[a:b] - at[a] + 1 + n)
            top = int(np.argmax(score[: far[a] - a]))
            if score[top] > best[0]:
                best = (float(score[top]), int(at[a]), int(at[a + top]) + 1)
                if best[0] == 1.0:
                    break
            rise = max(best[0], s) / float(score.max()) - 1 - 1e-9
            go_on = at[a] + min(step, rise * (n + self.low[name]))
        return best

    def scan(self, text: bytes) -> list[tuple[str, float, int, int]]:
        """As :meth:`find`, among runs of whole lines only."""
        lines = [(k, x.split()) for k, x in enumerate(text.translate(_WORD_BYTES).split(b"\n"))]
        lines = [(k, x) for k, x in lines if x]
        flat = [w for _, x in lines for w in x]
        if len(flat) < 2:
            return []
        known = self.known.get
        pairs = [known(p, -1) for p in zip(flat, flat[1:], strict=False)]
        hits = np.concatenate([[0], np.cumsum(np.array(pairs) >= 0), [0]])
        hits[-1] = hits[-2]  # the last word has no bigram of its own
        ends = np.cumsum([len(x) for _, x in lines])
        starts = ends - [len(x) for _, x in lines]
        least = self.similarity / (2 - self.similarity) - 1e-9
        dense = (hits[ends] - hits[starts] >= least * (ends - starts)) | (hits[ends - 1] - hits[starts] >= least * (ends - starts - 1)) & (ends - starts > 1)
        best: dict[str, tuple[float, int, int, int]] = {}
        tried = set()
        for middle in np.flatnonzero(dense).tolist():
            for first in range(middle, -1, -1):
                if ends[middle] - starts[first] - 1 > self.longest:
                    break
                for last in range(middle, len(lines)):
                    size = int(ends[last] - starts[first]) - 1
                    if size > self.longest:
                        break
                    if (first, last) not in tried:
                        tried.add((first, last))
                        self._compare(pairs, hits, int(starts[first]), size, (first, last), best)
        return sorted((name, score, lines[-before][0], lines[last][0] + 1) for name, (score, before, _, last) in best.items())

    def _compare(self, pairs: list[int], hits: np.ndarray, start: int, size: int, run: tuple[int, int], best: dict) -> None:
        shared = int(hits[start + size] - hits[start])
        for name, n in self.sizes.items():
            if self.low[name] <= size <= self.high[name] and 2 * shared >= self.similarity * (size + n) - 1e-9:
                score = self.dice(pairs[start : start + size], name)
                ranked = (score, -run[0], -(run[1] - run[0]), run[1])
                if score >= self.similarity and ranked > best.get(name, (0.0,)):
                    best[name] = ranked


def _in_lines(windows: list[tuple[str, float, int, int]], ends: np.ndarray) -> list[tuple[str, float, int, int]]:
    out = []
    for name, score, first, last in windows:
        rows = np.searchsorted(ends, [first, last], side="right").tolist()
        out.append((name, score, rows[0], rows[1] + 1))
    return out


_FOUND = T.StructType([T.StructField("license", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("first_line", T.LongType()), T.StructField("end_line", T.LongType())])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, similarity: float = SIMILARITY, text: str = "text", found: str = "licenses") -> DataFrame:
    """``docs`` without its text and with ``found``: for each template that is the nearest to some
    part, its name, the coefficient and the lines of the best such part, by name. A column named
    ``found``, in whatever case, is replaced. No shuffle."""
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), found.lower())]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(found, T.ArrayType(_FOUND))])
    kind = pa.list_(pa.struct([("license", pa.string()), ("score", pa.float64()), ("first_line", pa.int64()), ("end_line", pa.int64())]))
    chosen = all_templates() if templates is None else templates

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Templates(chosen, similarity)
        for batch in slices(it):
            rows = [[dict(zip(_FOUND.names, x, strict=True)) for x in scanner.nearest(t)] for t in utf8(batch.column(text))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(rows, kind)], names=[*kept, found])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """Per document: the number of matching templates, their names, the best one and its
    coefficient (ties: the first by name)."""
    found = scan(docs.select("doc_id", "text"), found="matches")
    best = F.array_max(F.transform("matches", lambda x: x["score"]))
    named = F.filter("matches", lambda x: x["score"] == best)
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_licenses"),
        F.array_join(F.transform("matches", lambda x: x["license"]), ",").alias("licenses"),
        F.try_element_at(named, F.lit(1))["license"].alias("best"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )
