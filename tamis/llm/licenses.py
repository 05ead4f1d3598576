"""License scans by sentences: normalised sentences get identifiers, and sequences of identifiers match ordered rules.

A text is cut into pieces at line ends, and after full stops and colons before white space. A known sentence is a run of
pieces: wrapped lines are joined, whatever comment leaders, banners of marks, indentation and blank lines stand between, and of several
known sentences that start at a piece the longest is taken. A normalised sentence is its letters and digits in lower case
with single spaces, so that marks between words and a change of case don't matter; a word that is hyphenated at a line end isn't joined.
Between known sentences, pieces count as one sentence up to a full stop, a colon or a blank line. Known sentences come from the notices
below. A rule is an ordered sequence of identifiers; it matches where its identifiers follow each other in order with at most `gap` other
sentences between two of them, and at least `cover` of them present, the first included. Of overlapping matches, the one
with more sentences stays, then the one that starts first.

Defined results: null and empty texts have no sentence and no row; a notice that is repeated is matched each time, and rows that repeat are
scanned each; an empty table gives an empty result; columns beyond doc_id and text aren't looked at. Very long texts are scanned whole; work is proportional to sentences times rules of a sentence.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

#: Licence: its notices, each a list of sentences in order. Public licence texts and their usual short notices.
NOTICES: dict[str, list[list[str]]] = {
    "MIT": [
        ["Released under the MIT License."],
        ["Licensed under the MIT License."],
        ["This project is licensed under the MIT License."],
        ["SPDX-License-Identifier: MIT"],
        [
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
            "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
            "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ],
    ],
    "Apache-2.0": [
        ["Licensed under the Apache License, Version 2.0."],
        ["SPDX-License-Identifier: Apache-2.0"],
        [
            "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
            "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
            "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
            "See the License for the specific language governing permissions and limitations under the License.",
        ],
    ],
    "GPL-3.0": [
        ["This work is licensed under the GNU General Public License, version 3."],
        ["Licensed under the GNU General Public License, version 3."],
        ["SPDX-License-Identifier: GPL-3.0-or-later"],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
            "You should have received a copy of the GNU General Public License along with this program.",
        ],
    ],
    "BSD-3-Clause": [
        ["Licensed under the BSD 3-Clause License."],
        ["SPDX-License-Identifier: BSD-3-Clause"],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
            "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ],
    ],
    "MPL-2.0": [
        [
            "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
            "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ],
        ["SPDX-License-Identifier: MPL-2.0"],
    ],
    "CC-BY-4.0": [["Licensed under CC BY 4.0."], ["This work is licensed under a Creative Commons Attribution 4.0 International License."]],
    "CC-BY-SA-4.0": [["Licensed under CC BY-SA 4.0."], ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]],
    "CC-BY-NC-4.0": [["Licensed under CC BY-NC 4.0."], ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]],
    "CC0-1.0": [["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]],
    "BSD-2-Clause": [
        ["Licensed under the BSD 2-Clause License."],
        [
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ],
    ],
    "ISC": [
        [
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
            "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
            "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ],
    ],
    "GPL-2.0": [
        ["Licensed under the GNU General Public License, version 2."],
        [
            "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU General Public License for more details.",
        ],
    ],
    "LGPL-3.0": [
        ["Licensed under the GNU Lesser General Public License, version 3."],
        [
            "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Lesser General Public License for more details.",
        ],
    ],
    "AGPL-3.0": [
        ["Licensed under the GNU Affero General Public License, version 3."],
        [
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
            "See the GNU Affero General Public License for more details.",
        ],
    ],
    "EPL-2.0": [["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"]],
    "Unlicense": [
        [
            "This is free and unencumbered software released into the public domain.",
            "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ],
    ],
}
DISCLAIMER = [
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
]
for _name in ("BSD-3-Clause", "BSD-2-Clause"):
    NOTICES[_name].append([*NOTICES[_name][-1], *DISCLAIMER])
#: Every licence has an identifier's line; those of the GNU family have two more.
for _name, _some in NOTICES.items():
    _forms = (_name, f"{_name}-only", f"{_name}-or-later") if "GPL" in _name else (_name,)
    _some += [[line] for line in (f"SPDX-License-Identifier: {x}" for x in _forms) if [line] not in _some]

_WORD = re.compile(r"[^\W_]+")
#: Comment leaders that are words; all others are marks.
_LEADER = re.compile(r"[^\S\n]*(?:dnl|rem)\b", re.IGNORECASE)
_SENTENCE = re.compile(r"(?:[^.:\n]|[.:](?!\s|$))+[.:]?", re.MULTILINE)


def normalised(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of a text's pieces."""
    return [m.span() for m in _SENTENCE.finditer(text)]


class Rules:
    """Identifiers of known sentences, and rules as sequences of them. A notice's own line ends and full stops cut it too."""

    def __init__(self, notices: dict[str, list[list[str]]] | None = None):
        self.ids: dict[str, int] = {}
        self.rules: list[tuple[str, list[int]]] = []
        for licence, some in (notices or NOTICES).items():
            for notice in some:
                parts = [normalised(s[a:b]) for s in notice for a, b in sentences(s)]
                self.rules.append((licence, [self.ids.setdefault(p, len(self.ids)) for p in parts if p]))
        self.starting: dict[int, list[int]] = {}
        for k, (_, seq) in enumerate(self.rules):
            self.starting.setdefault(seq[0], []).append(k)
        # by first word: others needn't be normalised
        self.heads: dict[str, list[str]] = {}
        for known in self.ids:
            self.heads.setdefault(known.split(" ", 1)[0], []).append(known + " ")

    def known(self, text: str) -> list[tuple[int, int, int, int]]:
        """(number of the sentence, identifier, start, end) of a text's known sentences."""
        pieces, n, ended, last = [], -1, True, 0
        for a, b in sentences(text):
            ended = ended or "\n" in text[last + 1 : a]
            start = _LEADER.match(text, a, b) if not a or text[a - 1] == "\n" else None
            word = _WORD.search(text, start.end() if start else a, b)
            if word:
                n += ended
                pieces.append((n, a, b, word.start(), word.group().lower()))
            # a line without a word ends a sentence as an empty one does
            ended, last = not word or text[b - 1] in ".:", b
        found, at = [], 0
        while at < len(pieces):
            open_, joined, best, whole = self.heads.get(pieces[at][4], ()), "", None, ""
            for j in range(at, len(pieces)):
                if not open_:
                    break
                joined += normalised(text[pieces[j][3] : pieces[j][2]]) + " "
                open_ = [k for k in open_ if k.startswith(joined)]
                if joined in open_:
                    best, whole = j, joined[:-1]
            if best is None:
                at += 1
            else:
                found.append((pieces[best][0], self.ids[whole], pieces[at][1], pieces[best][2]))
                at = best + 1
        return found

    def match(self, text: str, gap: int = 2, cover: float = 0.75) -> list[tuple[str, int, int, int, int, float]]:
        """(licence, rule, start, end, sentences matched, coverage) in order of the text."""
        known = self.known(text)
        ways = []
        for at, (_, k, _, _) in enumerate(known):
            for rule in self.starting.get(k, ()):
                seq = self.rules[rule][1]
                used, nxt = [at], 1
                for j in range(at + 1, len(known)):
                    if nxt == len(seq) or known[j][0] - known[used[-1]][0] > gap + 1:
                        break
                    if known[j][1] in seq[nxt:]:
                        nxt = seq.index(known[j][1], nxt) + 1
                        used.append(j)
                if len(used) >= cover * len(seq):
                    ways.append((-len(used), at, -len(used) / len(seq), rule, used))
        taken, out = set(), []
        for _, at, _, rule, used in sorted(ways, key=lambda w: w[:4]):
            if taken.isdisjoint(used):
                taken.update(used)
                licence, seq = self.rules[rule]
                out.append((licence, rule, known[at][2], known[used[-1]][3], len(used), len(used) / len(seq)))
        return sorted(out, key=lambda w: w[2])


LICENCES = "doc_id long, license string, rule int, start int, end int, n_sentences int, coverage double"


def scan_licenses(docs: DataFrame, gap: int = 2, cover: float = 0.75, notices=None) -> DataFrame:
    """One row per matched notice: doc_id, license, rule, start, end (code points), n_sentences, coverage."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rules = Rules(notices)
        for b in batches:
            rows = [(i, *m) for i, t in zip(b["doc_id"], b["text"], strict=True) if t for m in rules.match(t, gap, cover)]
            yield pd.DataFrame(rows, columns=["doc_id", "license", "rule", "start", "end", "n_sentences", "coverage"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(of, LICENCES)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
