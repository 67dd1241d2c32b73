"""License scans by template-markup matching.

A template is mandatory wording with `[optional wording]` and `{n}` regions that may hold up to
n words of any kind (a name, say). Each template is compiled into a token automaton (an NFA over
words, with skips); a text is accepted where the mandatory wording matches word for word. All
automata start from one table of first words, in one pass over the text. Labels ending in `-text`
stand for whole licences, `-header` for a licence's whole standard header, `-notice` for a short
reference to a licence. Fixed phrases (PHRASES) are the base scan.

Defined results: a null or empty text has no words and score 0; repeated rows give equal
values; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

#: Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL {15} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
    "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
    "the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD_1_2 = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: [1] "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. [2] Redistributions in binary form "
    "must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "Neither the name of {20} nor the names of [its] [their] [other] contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY {15} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND '
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {15} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY "
    "OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and[/or] distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    '. THE SOFTWARE IS PROVIDED "AS IS" AND {10} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
    "EVENT SHALL {10} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN "
    "AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)


def _gnu_header(name: str, version: str) -> str:
    return (
        f"is free software [;] [:] you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation[,] [;] either version {version} of the "
        "License, or (at your option) any later version. {6} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    )


#: Label -> templates, in the licences' own wording.
TEMPLATES = {
    "mit-text": [f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the Software. {_AS_IS}"],
    "mit-0-text": [f"{_MIT}. {_AS_IS}"],
    "bsd-2-clause-text": [_BSD_1_2 + _BSD_END],
    "bsd-3-clause-text": [_BSD_1_2 + "[3] " + _BSD_NAMES + _BSD_END],
    "bsd-4-clause-text": [_BSD_1_2 + "[3] All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by {20} [4] " + _BSD_NAMES + _BSD_END],
    "isc-text": [f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies{_ISC_END}"],
    "0bsd-text": [_ISC + _ISC_END],
    "zlib-text": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: [1] The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. [2] Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. [3] This notice may not be removed or altered from any source distribution."
    ],
    "bsl-1.0-text": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "
        '"Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the '
        "Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction "
        "and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works "
        "are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR "
        "ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR "
        "THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ],
    "unlicense-text": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _AS_IS
    ],
    "apache-2.0-header": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at [http] [https] '
        "www.apache.org/licenses/LICENSE-2.0 [.html] Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "gpl-3.0-header": [_gnu_header("General Public License", "3")],
    "gpl-2.0-header": [_gnu_header("General Public License", "2")],
    "lgpl-3.0-header": [_gnu_header("Lesser General Public License", "3")],
    "agpl-3.0-header": [_gnu_header("Affero General Public License", "3")],
    "mpl-2.0-header": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at [http] [https] mozilla.org/MPL/2.0"
    ],
    "mit-notice": ["[released] [licensed] [distributed] under the MIT License"],
    "apache-2.0-notice": ["licensed under the Apache License [,] Version 2.0", "Apache License [Version 2.0] [January 2004] http www apache org licenses"],
    "gpl-3.0-notice": ["licensed under the GNU General Public License version 3", "GNU General Public License as published by the Free Software Foundation [either] version 3 [of the License]"],
    "gpl-2.0-notice": ["licensed under the GNU General Public License version 2", "GNU General Public License as published by the Free Software Foundation [either] version 2 [of the License]"],
    "cc-by-4.0-notice": ["licensed under [a] [the] [Creative Commons] CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-4.0-notice": ["licensed under [the] CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc-4.0-notice": ["licensed under [the] CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0-notice": ["CC0 1.0 [Universal] [Public Domain Dedication]"],
    "copyright-notice": ["copyright [(c)] {3} all rights reserved"],
}
#: ASCII but digits and letters part words; A-Z are lower-cased.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_PART = re.compile(r"\[([^\]]*)\]|\{(\d+)\}|([^\[{]+)")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Automaton:
    """States are places in the template; a step goes on by one word, a skip without any."""

    def __init__(self, template: str):
        self.words: list[bytes | None] = []  # None: any word
        self.skips: dict[int, list[int]] = {}
        fixed: list[bytes] = []
        for optional, gap, wording in _PART.findall(template):
            at = len(self.words)
            if gap:
                for i in range(int(gap)):
                    self.skips.setdefault(at + i, []).append(at + int(gap))
                self.words += [None] * int(gap)
            elif wording:
                self.words += words_of(wording)
                fixed += words_of(wording)
            else:
                self.words += words_of(optional)
                self.skips.setdefault(at, []).append(len(self.words))
        self.first = {self.words[i] for i in self.closure({0})}
        if None in self.first:
            raise ValueError("a template starts with wording")
        self.rare = max(fixed, key=len)  # no text without this word is accepted

    def closure(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for nxt in self.skips.get(todo.pop(), ()):
                if nxt not in out:
                    out.add(nxt)
                    todo.append(nxt)
        return out

    def match(self, words: list[bytes], start: int) -> int:
        """End of the longest match that starts at this word, or -1."""
        states, end = self.closure({0}), -1
        for at in range(start, len(words) + 1):
            if len(self.words) in states:
                end = at
            if at == len(words):
                break
            states = self.closure({s + 1 for s in states if s < len(self.words) and self.words[s] in (None, words[at])})
            if not states:
                break
        return end


class LicenseScanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.templates = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]

    def scan(self, text: str) -> dict:
        words = words_of(text)
        joined = b" " + b" ".join(words) + b" "
        starts, base = [], set()
        for phrase, label in self.phrases:
            at, seen, before = joined.find(phrase), 0, 0
            while at >= 0:
                before += joined.count(b" ", seen, at)
                starts.append(before)
                base.add(label)
                seen, at = at, joined.find(phrase, at + 1)
        begin: dict[bytes, list[int]] = {}
        for k, (_, auto) in enumerate(self.templates):
            if b" " + auto.rare + b" " in joined:
                for w in auto.first:
                    begin.setdefault(w, []).append(k)
        spans, free = [], [0] * len(self.templates)
        for at, w in enumerate(words) if begin else ():
            for k in begin.get(w, ()):
                if at >= free[k] and (end := self.templates[k][1].match(words, at)) >= 0:
                    spans.append((self.templates[k][0], at, end))
                    free[k] = end
        return {"n_words": len(words), "starts": starts, "base": base, "labels": base | {s[0] for s in spans}, "spans": spans}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, with_spans: bool = False) -> DataFrame:
    """doc_id and the scan; score: 0 without a find, 0.5 for phrases alone, up to 1 with the words a template covers."""
    ship(docs.sparkSession)
    templates = templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates)
        for b in batches:
            rows = []
            for value in b.column(1):
                s = scanner.scan(value.as_py() or "")
                covered = sum(e - a for _, a, e in s["spans"])
                score = 0.5 + 0.5 * covered / (covered + 5) if s["labels"] else 0.0
                row = [s["n_words"], len(s["starts"]), min(s["starts"], default=None), max(s["starts"], default=None), ",".join(sorted(s["base"])), ",".join(sorted(s["labels"])), score]
                rows.append([*row, [{"label": x, "start": a, "end": e} for x, a, e in s["spans"]]])
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            n = 8 if with_spans else 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(n))], ["doc_id", *names[:n]])

    more = ", spans array<struct<label string, start long, end long>>" if with_spans else ""
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}{more}")
