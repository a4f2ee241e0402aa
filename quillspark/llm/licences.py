"""Licence scans: units of text compared with licence templates by Dice coefficient over word bigrams.

A document's units are its lines, its paragraphs and its whole text.  With n and m distinct bigrams the coefficient is
at most 2 min(n, m) / (n + m), so a unit is compared only with templates whose size lies within the bounds that the
threshold sets, and only with those that share a bigram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[a-z0-9]+")
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")

#: Licence notices and texts by name.
TEMPLATES: dict[str, str] = {
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at '
        'http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, '
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "bsd-2-clause-notice": "Redistributed under the two-clause BSD License.",
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
        "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
        "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, "
        "STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE '
        "FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
}


def bigrams(text: str) -> frozenset[tuple[bytes, bytes]]:
    """Distinct pairs of neighbouring words; words are runs of ASCII letters and digits, lower-cased."""
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower())
    return frozenset(zip(words, words[1:], strict=False))


def units(text: str | None) -> Iterator[str]:
    """Distinct lines, paragraphs and the whole text."""
    if text:
        yield from dict.fromkeys([*text.split("\n"), *_PARAGRAPH.split(text), text])


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        self.grams = {name: bigrams(text) for name, text in sorted(templates.items())}
        sizes = [len(g) for g in self.grams.values() if g]
        ratio = (2 - threshold) / threshold
        self.least, self.most = (min(sizes) / ratio, max(sizes) * ratio) if sizes else (1, 0)
        self.index: dict[tuple[bytes, bytes], list[str]] = {}
        for name, grams in self.grams.items():
            for g in grams:
                self.index.setdefault(g, []).append(name)

    def matches(self, text: str | None) -> dict[str, float]:
        """Templates that a unit of the text matches, with the best coefficient of each."""
        best: dict[str, float] = {}
        for unit in units(text):
            # A bigram takes at least three bytes and two of them may share a word: a cheap bound before splitting.
            if len(unit) < 2 * self.least:
                continue
            own = bigrams(unit)
            if not self.least <= len(own) <= self.most:
                continue
            shared: dict[str, int] = {}
            for g in own:
                for name in self.index.get(g, ()):
                    shared[name] = shared.get(name, 0) + 1
            for name, n in shared.items():
                size = len(self.grams[name])
                if 2 * min(size, len(own)) >= self.threshold * (size + len(own)):
                    dice = 2 * n / (size + len(own))
                    if dice >= self.threshold and dice > best.get(name, 0.0):
                        best[name] = dice
        return best


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: id, ``licence`` (best template, ties by name; null if none), ``dice`` and ``n_licences``.

    ``matches`` maps every matched template to its best coefficient.  Defined cases: null and empty texts match nothing; very long texts are read whole;
    repeated rows get equal answers; null ids stay null; an empty table gives no rows; other columns are not read.
    """
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.matches(t) for t in batch.column(1).to_pylist()]
            top = [min(f.items(), key=lambda x: (-x[1], x[0])) if f else (None, 0.0) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t[0] for t in top], pa.string()), pa.array([t[1] for t in top], pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sorted(f.items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                ["k", "licence", "dice", "n_licences", "matches"],
            )

    out = source.mapInArrow(run, f"k {kind}, licence string, dice double, n_licences long, matches map<string,double>")
    return out.withColumnRenamed("k", id_col)
