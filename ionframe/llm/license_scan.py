"""Licence scans: normalised text against licence templates by Dice coefficient.

Text and templates are normalised to lower-case words of ASCII letters and digits.  A window
of a text matches a template if the Dice coefficient of their sets of word bigrams,
2 |A and B| / (|A| + |B|), is at least THRESHOLD (t).  From that follow bounds that prune
without losing a match: the window's set has between |B| t / (2 - t) and |B| (2 - t) / t
bigrams, and at least that lower number of them are in B.  So a text is looked at for a
template only if it has so many different bigrams of B; all other templates and texts are
dropped by counting.

A licence's version tells it from others of nearly the same words, so a window has to hold the template's
bigrams of a version (a number behind one of VERSION_WORDS).  Of windows that share words, of one
template or several, only the best is a match: that of the largest coefficient, then of the larger
template, then the first; so a place of a text has one licence.

A window begins with a bigram that does not come again within it and ends with one that is new
to it, as it could be made shorter otherwise.  So windows that are open at a position begin with
different bigrams of at most |B| (2 - t) / t, and the work is at most a text's length times
that, however often it repeats itself.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
_WORD = re.compile(rb"[a-z0-9]+")
#: Words behind which a number is a version.
VERSION_WORDS = {b"version", b"v", b"license", b"by", b"sa", b"nc", b"attribution"}

# The notices as their publishers word them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-3-Clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS "
        "BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Zlib-text": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
        "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute "
        "it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "BSL-1.0-grant": (
        'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this '
        'license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to '
        "permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, "
        "including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all "
        "derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-2-Clause-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation; either version 2 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "LGPL-3.0-header": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."
    ),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."
    ),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "EPL-2.0-header": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense-opening": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "All-rights-reserved": "Copyright All rights reserved",
}


def normal_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").lower().encode())


class Scanner:
    """Matches of every template in a text."""

    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.names = list(templates)
        self.threshold = threshold
        words = [normal_words(t) for t in templates.values()]
        self.ids = {w: i + 1 for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        self.width = len(self.ids) + 1
        self.sets = [{self.ids[a] * self.width + self.ids[b] for a, b in zip(ws, ws[1:])} for ws in words]
        if len(self.names) > 63 or not all(self.sets):
            raise ValueError("1 to 63 templates of at least two words are taken")
        self.versions = [sorted({self.ids[a] * self.width + self.ids[b] for a, b in zip(ws, ws[1:]) if a in VERSION_WORDS and b[:1].isdigit()}) for ws in words]
        self.table = np.zeros(self.width**2, np.int64)
        for i, s in enumerate(self.sets):
            self.table[list(s)] |= 1 << i
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.least = [int(np.ceil(len(s) * low - 1e-9)) for s in self.sets]
        self.most = [int(np.floor(len(s) * high + 1e-9)) for s in self.sets]

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, dice, first word, word after the last) of every match, by place."""
        found = [(-dice, -len(self.sets[i]), start, end, i) for i, windows in self.windows(text) for dice, start, end in windows]
        taken: list[tuple[int, int]] = []
        out = []
        for dice, _, start, end, i in sorted(found):
            # windows that were taken are apart, so only those beside this one can touch it
            k = bisect.bisect(taken, (start, end))
            if (k and taken[k - 1][1] > start) or (k < len(taken) and taken[k][0] < end):
                continue
            taken.insert(k, (start, end))
            out.append((self.names[i], -dice, start, end))
        return sorted(out, key=lambda m: m[2])

    def windows(self, text: str | None) -> list[tuple[int, list[tuple[float, int, int]]]]:
        """(template, windows) of each template that has windows of the threshold: the best of those
        that begin at each place, as dice, first word and word after the last."""
        words = normal_words(text)
        if len(words) < 2:
            return []
        w = np.fromiter((self.ids.get(x, 0) for x in words), np.int64, len(words))
        pairs = w[:-1] * self.width + w[1:]
        pairs[(w[:-1] == 0) | (w[1:] == 0)] = 0
        masks = self.table[pairs]
        at = np.flatnonzero(masks)
        if not len(at):
            return []
        seen = np.unique(pairs[at])
        different = self.table[seen]
        out, before = [], None
        for i in range(len(self.names)):
            if np.count_nonzero((different >> i) & 1) < self.least[i] or not np.isin(self.versions[i], seen).all():
                continue
            if before is None:
                before, after = self._neighbours(words, w)
            found = self._windows(i, (masks >> i) & 1 == 1, pairs, before, after)
            if found:
                out.append((i, found))
        return out

    def _neighbours(self, words: list[bytes], w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each bigram the positions where it was last and comes next (-1 and the number of
        bigrams where there are none); words that are in no template are told apart."""
        own: dict[bytes, int] = {}
        for k in np.flatnonzero(w == 0).tolist():
            w[k] = own.setdefault(words[k], self.width + len(own))
        pairs = w[:-1] * (self.width + len(own)) + w[1:]
        n = len(pairs)
        order = np.argsort(pairs, kind="stable")
        same = pairs[order[1:]] == pairs[order[:-1]]
        before, after = np.full(n, -1), np.full(n, n)
        before[order[1:][same]] = order[:-1][same]
        after[order[:-1][same]] = order[1:][same]
        return before, after

    def _windows(self, i: int, hit: np.ndarray, pairs: np.ndarray, before: np.ndarray, after: np.ndarray):
        size, most, out = len(self.sets[i]), self.most[i], []
        # a window begins and ends at a hit, else a part of it would be at least as good
        for start in np.flatnonzero(hit).tolist():
            stop, reach = int(after[start]), start + most
            while True:
                part = slice(start, min(stop, reach))
                new = before[part] < start
                seen = np.cumsum(new)
                if part.stop == stop or seen[-1] > most:
                    break
                reach = start + 2 * (reach - start)
            common = np.cumsum(new & hit[part])
            dice = np.where(seen <= most, 2 * common / (seen + size), 0)
            for version in self.versions[i]:
                dice = np.where(np.logical_or.accumulate(pairs[part] == version), dice, 0)
            k = int(dice.argmax())
            if dice[k] >= self.threshold:
                out.append((float(dice[k]), start, start + k + 2))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, first_word, end_word) for each row of docs and each place of its
    whole text that matches a template; word numbers are those of the normalised text.

    Null and empty texts have no match; repeated rows come back as often as they are there;
    other columns are ignored.  templates are other texts of any length by name, as of whole
    licences; the default ones are notices, headers and the short licences.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches):
        s = Scanner(templates, threshold)
        for b in batches:
            rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for m in s.scan(t)]
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "license", "dice", "first_word", "end_word"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, license string, dice double, first_word long, end_word long")
