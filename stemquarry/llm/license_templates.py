"""Operator 3: license scan by template-markup matching.

A template is text with two kinds of markup: ``<<optional>> ... <<end>>`` may be absent, and
``<<any n>>`` stands for up to n words of any kind; everything else is mandatory wording.  There are
whole licenses and the notices by which files and pages refer to one.  Each template is compiled
into a token automaton (Thompson construction over words, then subset construction over the
template's own vocabulary plus one symbol for all other words).  A text holds a template where the
automaton, started at some word, reaches acceptance, so all mandatory words stand there exactly and
in order.  The matches of one template are its leftmost, longest ones without overlap; places where
matches of several templates overlap count once.

Texts are cut into words by array passes over their bytes and words are compared by 64-bit hashes.
Fixed base phrases are found by comparing shifted hash arrays.  An automaton runs only in texts
that hold every mandatory word of its template, from the places where it can start, and for no more
words than its longest wording has.

Labels of the base phrases are kept and the labels of matched templates are added.  The score is 1
with a whole template, 0.5 with base phrases alone, 0 without either.

Defined results: null is an empty text; texts without words have zero counts, null places and empty
labels; phrases that overlap or repeat are all counted; labels are distinct and sorted; repeated
rows are scanned one by one; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship
from .textkernel import Words, blocks, class_table, span_hashes

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_templates long"
)

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Licenses and license notices as templates, by label.
TEMPLATES = {
    "gpl-notice": "licensed under the <<optional>>terms of the<<end>> gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license",
    "gpl-2.0": "licensed under the <<optional>>terms of the<<end>> gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 2",
    "gpl-3.0": "licensed under the <<optional>>terms of the<<end>> gnu general public license <<optional>>as published by the free software foundation<<end>> <<optional>>either<<end>> version 3",
    "gpl-header": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation <<optional>>either<<end>> version <<any 1>> <<optional>>of the license<<end>> <<optional>>or at your option any later version<<end>>
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu general public license for more details""",
    "lgpl-header": """
        this <<any 2>> is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> <<optional>>library<<end>> general public license as published by
        the free software foundation <<optional>>either<<end>> version <<any 2>> <<optional>>of the license<<end>> <<optional>>or at your option any later version<<end>>
        this <<any 2>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu <<optional>>lesser<<end>> <<optional>>library<<end>> general public license for more details""",
    "agpl-header": """
        this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by
        the free software foundation <<optional>>either<<end>> version 3 <<optional>>of the license<<end>> <<optional>>or at your option any later version<<end>>
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
        see the gnu affero general public license for more details""",
    "apache-2.0": "licensed under the apache license version 2 0 <<optional>>the license<<end>>",
    "apache-2.0-header": """
        licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
        <<optional>>http<<end>> <<optional>>https<<end>> www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license""",
    "cc-by-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by 4 0",
    "cc-by-sa-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc 4 0",
    "cc-by-nc-sa-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nc sa 4 0",
    "cc-by-nd-4.0": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> cc by nd 4 0",
    "cc-attribution": "licensed under <<optional>>a<<end>> <<optional>>the<<end>> creative commons attribution <<any 3>> <<optional>>international<<end>> license",
    "mit-notice": "<<optional>>is<<end>> <<optional>>released<<end>> <<optional>>licensed<<end>> under the <<optional>>terms of the<<end>> mit license",
    "mit": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "mit-0": """
        permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall <<any 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "bsd-2-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by <<any 10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall <<any 10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "bsd-3-clause": """
        redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
        <<any 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        <<any 1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        <<any 1>> neither the name of <<any 10>> nor the names of <<any 3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission
        this software is provided by <<any 10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
        in no event shall <<any 10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services
        loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise
        arising in any way out of the use of this software even if advised of the possibility of such damage""",
    "isc": """
        permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
        the software is provided as is and <<any 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
        in no event shall <<any 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software""",
    "zlib": """
        this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions
        <<any 1>> the origin of this software must not be misrepresented you must not claim that you wrote the original software
        if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required
        <<any 1>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software
        <<any 1>> this notice may not be removed or altered from any source distribution""",
    "bsl-1.0": """
        permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software
        to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following
        the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part
        and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement
        in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
    "mpl-2.0-header": """
        this source code form is subject to the terms of the mozilla public license v 2 0
        if a copy of the mpl was not distributed with this file you can obtain one at <<optional>>http<<end>> <<optional>>https<<end>> <<optional>>www<<end>> mozilla org mpl 2 0""",
    "unlicense": """
        this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software
        either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means
        in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain
        we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
        we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law
        the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
        in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise
        arising from out of or in connection with the software or the use or other dealings in the software""",
}

WORD = class_table(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
_NOT_WORD = ~WORD


def word_hashes(text: str) -> np.ndarray:
    return Words(pa.array([text], pa.string()), blank=_NOT_WORD).hash


class TokenAutomaton:
    """A template as a deterministic automaton over word symbols (0: a word outside its vocabulary)."""

    def __init__(self, template: str):
        self.words: dict[int, int] = {}
        moves: list[list[tuple[int | None, int]]] = [[]]  # (symbol or None for any word, next)
        empty: list[list[int]] = [[]]

        def state() -> int:
            moves.append([])
            empty.append([])
            return len(moves) - 1

        now, opened, depth = 0, [], 0
        self.mandatory: set[int] = set()
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<optional>>":
                opened.append(now)
                depth += 1
            elif part == "<<end>>":
                end = state()
                empty[now].append(end)
                empty[opened.pop()].append(end)
                now, depth = end, depth - 1
            elif part.startswith("<<any "):
                end = state()
                empty[now].append(end)
                for _ in range(int(part[6:-2])):
                    step = state()
                    moves[now].append((None, step))
                    empty[step].append(end)
                    now = step
                now = end
            else:
                for h in word_hashes(part).tolist():
                    symbol = self.words.setdefault(h, len(self.words) + 1)
                    if not depth:
                        self.mandatory.add(h)
                    step = state()
                    moves[now].append((symbol, step))
                    now = step
        final = now

        def closure(states: set[int]) -> frozenset[int]:
            seen, stack = set(), [*states]
            while stack:
                s = stack.pop()
                if s not in seen:
                    seen.add(s)
                    stack += empty[s]
            return frozenset(seen)

        begin = closure({0})
        number, todo = {begin: 0}, [begin]
        self.step: list[list[int]] = []
        self.accepting: list[bool] = []
        while todo:
            states = todo.pop(0)
            self.accepting.append(final in states)
            anything = {t for s in states for sym, t in moves[s] if sym is None}
            wanted: dict[int, set[int]] = {0: anything}
            for s in states:
                for sym, t in moves[s]:
                    if sym is not None:
                        wanted.setdefault(sym, set(anything)).add(t)
            reached = {}
            for symbol, targets in wanted.items():
                to = closure(targets)
                if to and to not in number:
                    number[to] = len(number)
                    todo.append(to)
                reached[symbol] = number[to] if to else -1
            row = [reached.get(symbol, reached[0]) for symbol in range(len(self.words) + 1)]
            self.step.append(row)
        self.starters = np.array([h for h, k in self.words.items() if self.step[0][k] >= 0], np.uint64)
        #: words of the longest wording
        self.longest = sum(int(part[6:-2]) if part.startswith("<<any ") else 0 if part.startswith("<<") else word_hashes(part).size for part in re.split(r"(<<[^>]*>>)", template))

    def matches(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(first word, end) of the leftmost, longest, non-overlapping matches in a text."""
        if not self.mandatory <= set(hashes.tolist()):
            return []
        out, done = [], 0
        for at in np.flatnonzero(np.isin(hashes, self.starters)).tolist():
            if at < done:
                continue
            state, end = 0, 0
            for i, h in enumerate(hashes[at : at + self.longest].tolist(), at + 1):
                state = self.step[state][self.words.get(h, 0)]
                if state < 0:
                    break
                if self.accepting[state]:
                    end = i
            if end:
                out.append((at, end))
                done = end
        return out


@lru_cache(maxsize=1)
def _machines() -> tuple[dict[str, np.ndarray], dict[str, TokenAutomaton], np.ndarray]:
    phrases = {p: word_hashes(p) for p in PHRASES}
    automata = {label: TokenAutomaton(t) for label, t in TEMPLATES.items()}
    # the longest mandatory word of each template is rare in running text
    rare = np.unique(
        np.array([int(word_hashes(max(re.sub(r"<<optional>>.*?<<end>>|<<[^>]*>>", " ", t).split(), key=len))[0]) for t in TEMPLATES.values()], np.uint64)
    )
    return phrases, automata, rare


def _places(found: dict[str, list[tuple[int, int]]]) -> int:
    """Number of places: matches of any templates that overlap are one."""
    n, reach = 0, -1
    for a, b in sorted(m for at in found.values() for m in at):
        n += a >= reach
        reach = max(reach, b)
    return n


def licenses(docs: DataFrame) -> DataFrame:
    """License places and labels of every text; see the module docstring."""
    ship(docs.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, automata, rare = _machines()
        for block in blocks(batches):
            w = Words(block.column("text"), blank=_NOT_WORD)
            count = w.count
            hits: dict[int, list[tuple[int, str]]] = {}
            for phrase, hashes in phrases.items():
                at = np.flatnonzero(w.hash == hashes[0])
                for j, h in enumerate(hashes[1:].tolist(), 1):
                    at = at[at + j < w.hash.size]
                    at = at[w.hash[at + j] == np.uint64(h)]
                doc = np.searchsorted(w.first, at, side="right") - 1
                inside = at + hashes.size <= w.first[doc + 1]
                for d, a in zip(doc[inside].tolist(), at[inside].tolist(), strict=True):
                    hits.setdefault(d, []).append((a - int(w.first[d]), PHRASES[phrase]))
            some = np.unique(np.searchsorted(w.first, np.flatnonzero(np.isin(w.hash, rare)), side="right") - 1)
            found = {}
            for d in some.tolist():
                own = w.hash[w.first[d] : w.first[d + 1]]
                found[d] = {label: at for label, a in automata.items() if (at := a.matches(own))}
            rows = []
            for d in range(count.size):
                places, labels = hits.get(d, []), found.get(d, {})
                base = sorted({x[1] for x in places})
                start = [x[0] for x in places]
                rows.append(
                    (
                        int(count[d]),
                        len(start),
                        min(start, default=None),
                        max(start, default=None),
                        ",".join(base),
                        ",".join(sorted({*base, *labels})),
                        1.0 if labels else 0.5 if base else 0.0,
                        _places(labels),
                    )
                )
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
