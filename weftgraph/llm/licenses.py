"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template's markup is ``[[ ... ]]`` for an optional region and ``{n}`` for a replaceable one of up to n words; all
else is mandatory wording, given as it is written and compared word by word. It compiles into a nondeterministic
automaton over words whose states are advanced together; a text is accepted where the mandatory wording matches
exactly. Automata start at each place of the template's first word in texts that hold its longest mandatory word, so
nothing is skipped and most texts cost one scan. Beside the labels of templates there are base phrases, found
wherever their words stand consecutively. The bank holds whole licences and the notices by which texts name one.

The score is 1 - 2 ** (-n / 4) for the longest accepted wording of n words, phrases included, and 0 without any: a
whole licence is near 1, a bare name below a half.

All rows are scanned, whole, with no shuffle. Cases: null and empty texts have no words, places or labels and
score 0. Repeated rows give equal rows. Very long texts are scanned to their end. Other columns are carried along,
whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import as_bytes, free_name, positional, table

#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: [[1]] Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. [[2]] Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY {12} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {12} BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND
ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_NO_WARRANTY = """is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""

#: Public licenses and the notices that name them, in the markup above.
TEMPLATES = {
    "mit": [
        "released under the [[terms of the]] mit license",
        "licensed under the [[terms of the]] mit license",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice [[(including the next paragraph)]] shall be included in all copies or
        substantial portions of the Software. """ + _AS_IS + """ IN NO EVENT SHALL {12} BE LIABLE FOR ANY CLAIM, DAMAGES
        OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION
        WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "apache": ["licensed under the apache license [[version {3}]] [[the license]]"],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at {8} Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    ],
    "gpl": ["licensed under the [[terms of the]] gnu general public license", "under the terms of the gnu general public license as published by the free software foundation"],
    "gpl-2.0": [
        """is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. {4} """ + _NO_WARRANTY,
    ],
    "gpl-3.0": [
        "gnu general public license [[as published by the free software foundation either]] version 3",
        """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, [[either]] version 3 of the License[[, or (at your option) any later
        version]]. {4} """ + _NO_WARRANTY + " See the GNU General Public License for more details.",
    ],
    "lgpl": [
        "gnu lesser general public license",
        """is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any
        later version. {4} """ + _NO_WARRANTY,
    ],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-2-clause": [_BSD + " " + _BSD_END],
    "bsd-3-clause": [
        _BSD + """ [[3]] Neither the name of {12} nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission. """ + _BSD_END,
    ],
    "isc": [
        """Permission to use, copy, modify, and {1} distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND {8} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL {8} BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
        DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
        NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: [[1]] The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. [[2]] Altered source versions must be plainly marked as such, and must
        not be misrepresented as being the original software. [[3]] This notice may not be removed or altered from any
        source distribution.""",
    ],
    "bsl-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute,
        execute, and transmit the Software, and to prepare derivative works of the Software""",
        "distributed under the boost software license version 1 0",
    ],
    "mpl-2.0": [
        "mozilla public license version 2 0",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at {8}""",
    ],
    "cc-by": ["licensed under {6} cc by [[{1} 0]]", "licensed under a creative commons attribution [[{4}]] license"],
    "cc-by-nc": ["licensed under {6} cc by nc", "creative commons attribution noncommercial [[{3}]] license"],
    "cc0": ["cc0 1 0 universal"],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    ],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"],
}
_fold = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(raw: bytes) -> bytes:
    """A-Z lower-cased, what isn't of a word as spaces."""
    return raw.translate(_fold)


class Automaton:
    """moves[s]: (word or None for any, next state); skips[s]: states reached for nothing."""

    def __init__(self, template: str) -> None:
        self.moves: list[list[tuple[bytes | None, int]]] = [[]]
        self.skips: list[list[int]] = [[]]
        self.required: list[bytes] = []
        at, opened = 0, []
        markup = re.split(r"(\[\[|\]\]|\{\d+\})", template)
        for token in [t for i, part in enumerate(markup) for t in ([part] if i % 2 else words_of(part.encode()).decode().split())]:
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.skips[opened.pop()].append(at)
            elif token[0] == "{":
                begin = at
                spots = [begin]
                for _ in range(int(token[1:-1])):
                    at = self._step(at, None)
                    spots.append(at)
                for s in spots[:-1]:
                    self.skips[s].append(at)
            else:
                if not opened:
                    self.required.append(token.encode())
                at = self._step(at, token.encode())
        self.end = at
        self.starts = {w for state in self._closure({0}) for w, _ in self.moves[state]}  # None: any word
        self.anchor = max(self.required, key=len)

    def _step(self, at: int, word: bytes | None) -> int:
        self.moves.append([])
        self.skips.append([])
        self.moves[at].append((word, len(self.moves) - 1))
        return len(self.moves) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes], start: int) -> int:
        """The number of words of the longest wording accepted from here on, 0 if none."""
        states, longest = self._closure({0}), 0
        for i in range(start, len(words)):
            states = self._closure({t for s in states for w, t in self.moves[s] if w is None or w == words[i]})
            if not states:
                break
            if self.end in states:
                longest = i + 1 - start
        return longest


class Scanner:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> None:
        self.automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
        self.phrases = [(p.encode().split(), label) for p, label in phrases.items()]

    def scan(self, raw: bytes) -> tuple[int, list[tuple[int, str]], dict[str, int]]:
        """Number of words, the base places as (word, label), and the labels of templates with their longest wording."""
        t = words_of(raw)
        words = t.split()
        places: list[tuple[int, str]] = []
        found: dict[str, int] = {}
        for phrase, label in self.phrases:
            if max(phrase, key=len) in t:
                places += [(i, label) for i, w in enumerate(words) if w == phrase[0] and words[i : i + len(phrase)] == phrase]
        for label, a in self.automata:
            if a.anchor in t:
                n = max((a.accepts(words, i) for i, w in enumerate(words) if w in a.starts or None in a.starts), default=0)
                if n:
                    found[label] = max(n, found.get(label, 0))
        return len(words), places, found


def names(docs: DataFrame) -> tuple[str, ...]:
    """What scan() calls its columns on this table."""
    return tuple(free_name(docs, n) for n in ("_n_words", "_places", "_base", "_labels", "_score"))


def scan(docs: DataFrame, text: str = "text", templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """All rows with the number of words, places (base), base labels, labels (sorted) and score; see names()."""
    from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

    own = docs.columns
    kinds = [(LongType(), pa.int64()), (ArrayType(LongType()), pa.list_(pa.int64())), (ArrayType(StringType()), pa.list_(pa.string())), (ArrayType(StringType()), pa.list_(pa.string())), (DoubleType(), pa.float64())]
    more = [(n, *k) for n, k in zip(names(docs), kinds, strict=True)]

    def run(batches):
        scanner = Scanner(templates, phrases)
        size = {label: len(p) for p, label in scanner.phrases}
        for b in batches:
            rows = []
            for raw in as_bytes(b.column(own.index(text))):
                n, places, found = scanner.scan(raw)
                base = {label for _, label in places}
                longest = max([*found.values(), *(size[x] for x in base)], default=0)
                rows.append((n, sorted(i for i, _ in places), sorted(base), sorted(base | set(found)), 1 - 2 ** (-longest / 4)))
            made = [pa.array(list(x), kind) for x, (_, _, kind) in zip(zip(*rows, strict=True), more, strict=True)] if rows else [pa.array([], kind) for _, _, kind in more]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*own, *[x[0] for x in more]])

    return positional(docs).mapInArrow(run, StructType([*docs.schema.fields, *[StructField(n, t) for n, t, _ in more]]))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_words, places, base, labels, score = names(docs)
    return scan(docs).select(
        "doc_id",
        F.col(n_words).alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.col(score).alias("score"),
    )
