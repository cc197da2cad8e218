"""Licence texts and notices in documents, by the Dice coefficient of word bigrams.

Texts are normalised to lower-case words of letters and digits. A passage of a text is
compared with a licence template by 2 * shared / (passage + template) over their word
bigrams, counted with repetitions. A passage of p bigrams can reach a coefficient of t
with a template of q only if t / (2 - t) <= p / q <= (2 - t) / t, and only if they share
t * (p + q) / 2 bigrams. The first bounds the lengths of passages looked at for each
template, the second rules out the templates of which a text holds too few bigrams,
which for most texts is all of them. A best passage begins and ends with a bigram of
the template, so only such places are tried.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

THRESHOLD = 0.85

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."""

# The wording of common licences and notices.
TEMPLATES = (
    ("MIT", "full", _MIT),
    ("BSD-2-Clause", "full", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", "full", f"{_BSD} {_BSD_THIRD} {_BSD_END}"),
    ("ISC", "full", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-2.0", "header", _GPL.format("", 2)),
    ("GPL-3.0", "header", _GPL.format("", 3)),
    ("LGPL-2.1", "header", _GPL.format("Lesser ", "2 1")),
    ("LGPL-3.0", "header", _GPL.format("Lesser ", 3)),
    ("AGPL-3.0", "header", _GPL.format("Affero ", 3)),
    ("MPL-2.0", "header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "header", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "notice", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "notice", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "short", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "short", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "short", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "short", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "short", "Released under the MIT License."),
    ("MIT", "short", "Licensed under the MIT License."),
    ("BSD-3-Clause", "short", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "short", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "short", "This work is licensed under the GNU General Public License, version 3."),
    ("Proprietary", "short", "All rights reserved."),
)

_WORDS = re.compile(r"[^\W_]+")


def normalised(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


class Matcher:
    """Finds the best passages of a text for each of a list of templates (licence, form, wording)."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.templates, self.threshold = templates, threshold
        self.bigrams = [Counter(zip(w, w[1:], strict=False)) for w in (normalised(t[2]) for t in templates)]
        self.sizes = [c.total() for c in self.bigrams]
        self.of: dict[tuple[str, str], list[int]] = defaultdict(list)
        for i, bigrams in enumerate(self.bigrams):
            for b in bigrams:
                self.of[b].append(i)

    def __call__(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(template, first word, end word, coefficient) of each template's best passages that don't overlap each other."""
        words = normalised(text)
        places: dict[int, list[int]] = defaultdict(list)
        for i, b in enumerate(zip(words, words[1:], strict=False)):
            if b in self.of:
                for template in self.of[b]:
                    places[template].append(i)
        found = [m for template, at in places.items() for m in self.passages(words, template, at)]
        # the best of passages that overlap, of whatever template
        found.sort(key=lambda m: (-m[3], -(m[2] - m[1]), m[1], m[0]))
        kept: list[tuple[int, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for m in found:
            k = bisect.bisect(taken, (m[1], m[2]))
            if (k == 0 or taken[k - 1][1] <= m[1]) and (k == len(taken) or m[2] <= taken[k][0]):
                taken.insert(k, (m[1], m[2]))
                kept.append(m)
        return sorted(kept, key=lambda m: m[1])

    def passages(self, words: list[str], template: int, at: list[int]) -> list[tuple[int, int, int, float]]:
        """For each place of a template's bigrams the best passage that begins there, if it is good enough."""
        size, t = self.sizes[template], self.threshold
        least, most = math.ceil(size * t / (2 - t) - 1e-9), math.floor(size * (2 - t) / t + 1e-9)
        if len(at) < t * (size + least) / 2 - 1e-9:
            return []
        out = []
        for first, start in enumerate(at):
            # enough of the template's bigrams must lie within reach
            reach = bisect.bisect_left(at, start + most)
            if reach - first < t * (size + least) / 2 - 1e-9:
                continue
            left, shared, best = Counter(), 0, None
            for place in at[first:reach]:
                bigram = (words[place], words[place + 1])
                left[bigram] += 1
                shared += left[bigram] <= self.bigrams[template][bigram]
                length = place - start + 1
                if length >= least and (dice := 2 * shared / (length + size)) >= t and (best is None or dice > best[3]):
                    best = (template, start, place + 2, dice)
            if best:
                out.append(best)
        return out


def find(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, licences) for docs(doc_id, text): one row per row.

    licences is an array of (licence, form, first, stop, dice) in the order of the text;
    first and stop count normalised words. A null or blank text has none; null ids and
    repeated rows are kept; further columns are not read.
    """
    kind = pa.list_(pa.struct([("licence", pa.string()), ("form", pa.string()), ("first", pa.int64()), ("stop", pa.int64()), ("dice", pa.float64())]))
    held: dict[str, Matcher] = {}

    def over(batch: pa.RecordBatch) -> pa.RecordBatch:
        if "matcher" not in held:
            held["matcher"] = Matcher(templates, threshold)
        rows = [[{"licence": templates[i][0], "form": templates[i][1], "first": a, "stop": b, "dice": d} for i, a, b, d in held["matcher"](text)] for text in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "licences"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), over, "doc_id long, licences array<struct<licence:string,form:string,first:long,stop:long,dice:double>>")


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, n_licences, licences, best_dice): the licences found, in the order of the text, joined by commas."""
    found = F.col("licences")
    return find(docs).select(
        "doc_id",
        F.size(found).cast("long").alias("n_licences"),
        F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["licence"], x["first"].cast("string"), x["stop"].cast("string"))), ",").alias("licences"),
        F.coalesce(F.array_max(F.transform(found, lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )
