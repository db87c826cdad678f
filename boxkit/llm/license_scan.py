"""License scans by template-markup matching.

Templates follow the usual markup of license lists: plain words are mandatory,
``[[ ... ]]`` may be left out, ``<<n>>`` stands for up to n words of any kind
(a name, a year, a list of holders). A template is compiled to an automaton
over words; a text is accepted where a run through it meets all mandatory words
exactly. The templates are whole licenses where these are short, and the
notices that point to the long ones. Words are numbers of the templates'
vocabulary, found for a whole chunk at a time; automata start only where two
words in a row can begin a template or a phrase.

Defined cases: a null or wordless text has no places, null first and last
words, empty labels and score 0; repeated rows are judged alike, each by
itself; further columns are ignored; ties can't occur, as labels are distinct
and sorted.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_BSD = [
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "[[3]] neither the name of <<12>> nor the names of <<3>> contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "this software is provided by <<8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
]
_MIT = "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the <<3>> copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_ISC = "the software is provided as is and <<6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_GNU = "this <<3>> is free software you can redistribute it and or modify it under the terms of the gnu %s general public license as published by the free software foundation either version %s of the license or [[at your option]] any later version this <<3>> is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu %s general public license for more details"
#: label: templates. Names follow the public license identifiers.
TEMPLATES = {
    "gpl-3.0": ["[[licensed under]] [[the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3 [[of the license]]"],
    "gpl-2.0": ["[[licensed under]] [[the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2 [[of the license]]"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license"],
    "agpl": ["gnu affero general public license"],
    "apache-2.0": ["apache license [[version]] 2 0", "licensed under the apache license [[version 2 0]] [[the license]] you may not use this file except in compliance with the license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software " + _MIT],
    "bsd": [f"{_BSD[0]} {_BSD[2]}"],
    "bsd-3-clause": [f"{_BSD[0]} {_BSD[1]} {_BSD[2]}"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies " + _ISC],
    "mpl-2.0": ["mozilla public license [[version]] [[v]] 2 0"],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted " + _ISC],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution"],
    "bsl-1.0": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "apache-2.0-notice": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"],
    "gpl-2.0-or-later": [_GNU % ("", "2", "")],
    "gpl-3.0-or-later": [_GNU % ("", "3", "")],
    "lgpl-2.1-or-later": [_GNU % ("lesser", "2 1", "lesser")],
    "agpl-3.0-or-later": [_GNU % ("affero", "3", "affero")],
    "unlicense": ["this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
    "cc0": ["cc0 [[1 0]]", "creative commons zero"],
    "cc-by-nc": ["cc by nc", "creative commons attribution non commercial", "creative commons attribution noncommercial"],
    "cc-by-nc-sa": ["cc by nc sa"],
    "cc-by-nc-nd": ["cc by nc nd"],
    "cc-by-sa": ["cc by sa", "creative commons attribution share alike", "creative commons attribution sharealike"],
    "cc-by-nd": ["cc by nd", "creative commons attribution no derivatives"],
    "cc-by": ["creative commons attribution [[<<1>>]] [[4 0]] international"],
    "all-rights-reserved": ["copyright [[c]] [[<<1>>]] <<6>> all rights reserved"],
}
_MARK = re.compile(r"\[\[|\]\]|<<(\d+)>>|[^\s\[\]<>]+")


class Automaton:
    """States with word edges, free edges and any-word edges; state 0 starts. Words are what the number of a word gives."""

    def __init__(self, template: str, number=lambda w: w):
        self.words: list[dict] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        at, opened, self.mandatory = 0, [], 0
        for m in _MARK.finditer(template):
            if m[0] == "[[":
                opened.append(at)
            elif m[0] == "]]":
                end = self._new()
                self.free[at].append(end)
                self.free[opened.pop()].append(end)
                at = end
            elif m[1]:
                end_of = []
                for _ in range(int(m[1])):
                    end_of.append(at)
                    self.any[at] = to = self._new()
                    at = to
                for x in end_of:
                    self.free[x].append(at)
            else:
                to = self._new()
                self.words[at][number(m[0])] = to
                at = to
                self.mandatory += not opened
        self.accept = at
        self.first = {w for s in self._closure({0}) for w in self.words[s]}

    def _new(self) -> int:
        self.words.append({})
        self.free.append([])
        self.any.append(None)
        return len(self.words) - 1

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in states:
                    states.add(x)
                    todo.append(x)
        return states

    def second(self, word) -> set | None:
        """The words that can follow a first one; None if any can, or none needs to."""
        states = self._closure({t for s in self._closure({0}) if (t := self.words[s].get(word)) is not None})
        if self.accept in states or any(self.any[s] is not None for s in states):
            return None
        return {x for s in states for x in self.words[s]}

    def longest(self, words, at: int, end: int | None = None) -> int:
        """The end of the longest accepted run of words from ``at``, or 0."""
        states, found = self._closure({0}), 0
        for k in range(at, len(words) if end is None else end):
            step = {t for s in states if (t := self.words[s].get(words[k])) is not None} | {self.any[s] for s in states if self.any[s] is not None}
            if not step:
                break
            states = self._closure(step)
            if self.accept in states:
                found = k + 1
        return found


def _hash_of(ws: list[str]) -> np.ndarray:
    out = []
    for w in ws:
        b = np.frombuffer(w.encode(), dtype=np.uint8)
        out.append(C.word_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.array(out, dtype=np.uint64)


class Scanner:
    """Phrases and automata over word numbers; 0 is a word that none of them names."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        named = {w for p in phrases for w in p.split()} | {m[0] for ts in templates.values() for t in ts for m in _MARK.finditer(t) if m[0] not in ("[[", "]]") and not m[1]}
        names = sorted(named)
        hashes = _hash_of(names)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {names[k]: i + 1 for i, k in enumerate(order.tolist())}
        self.begin: dict[int, list] = {}
        pairs, free = set(), set()
        n = len(names) + 1
        for p, label in phrases.items():
            ws = [number[w] for w in p.split()]
            self.begin.setdefault(ws[0], []).append((ws, label, None))
            if len(ws) > 1:
                pairs.add(ws[0] * n + ws[1])
            else:
                free.add(ws[0])
        for label, ts in templates.items():
            for t in ts:
                a = Automaton(t, number.__getitem__)
                for w in a.first:
                    self.begin.setdefault(w, []).append((None, label, a))
                    after = a.second(w)
                    if after is None:
                        free.add(w)
                    else:
                        pairs |= {w * n + x for x in after}
        self.size, self.pairs, self.free = n, np.array(sorted(pairs), np.int64), np.array(sorted(free), np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + 1, 0)

    def starts(self, numbers: np.ndarray) -> np.ndarray:
        """Places where two words in a row, or the first alone, can begin something."""
        after = np.append(numbers[1:], 0)
        return np.flatnonzero(np.isin(numbers * self.size + after, self.pairs) | np.isin(numbers, self.free))

    def scan(self, numbers: np.ndarray, p: int, end: int):
        """(labels of phrases, [(label, last word + 1, mandatory words)]) from one place of a document that ends there."""
        base, found = [], []
        for phrase, label, automaton in self.begin.get(int(numbers[p]), ()):
            if phrase is not None:
                if p + len(phrase) <= end and numbers[p : p + len(phrase)].tolist() == phrase:
                    base.append(label)
            elif to := automaton.longest(numbers, p, end):
                found.append((label, to, automaton.mandatory))
        return base, found


SCHEMA = "n_words long, base array<struct<word: int, label: string>>, matched array<struct<label: string, first: int, end: int, fixed: int>>"
_BASE = pa.list_(pa.struct([("word", pa.int32()), ("label", pa.string())]))
_MATCHED = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("fixed", pa.int32())]))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """Per document its words, the places of the phrases, and what the templates match (by word)."""

    def run(batches):
        scanner = Scanner(phrases, templates)
        for b in batches:
            for lo, hi, buf, offs in C.chunks(b.column("text")):
                low = C.lower(buf)
                s, e, first = C.words(low, offs, blank=False)
                numbers = scanner.numbers(C.word_hashes(low, s, e)) if len(s) else np.empty(0, np.int64)
                hits = scanner.starts(numbers)
                base, found = [[] for _ in range(hi - lo)], [[] for _ in range(hi - lo)]
                for p, d in zip(hits.tolist(), (np.searchsorted(first, hits, "right") - 1).tolist(), strict=True):
                    at = int(first[d])
                    labels, matched = scanner.scan(numbers, p, int(first[d + 1]))
                    base[d] += [(p - at, x) for x in labels]
                    found[d] += [(x, p - at, to - at, fixed) for x, to, fixed in matched]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([[{"word": p, "label": x} for p, x in r] for r in base], _BASE), pa.array([[{"label": x, "first": p, "end": q, "fixed": k} for x, p, q, k in r] for r in found], _MATCHED)],
                    names=["doc_id", "n_words", "base", "matched"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score: 0 without a match; else from .5 up with the places and the words that a template fixes, below 1."""
    return scan(C.read(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_words",
        "cast(size(base) as long) AS n_base",
        "cast(array_min(transform(base, x -> x.word)) as long) AS first_word",
        "cast(array_max(transform(base, x -> x.word)) as long) AS last_word",
        "array_join(array_sort(array_distinct(transform(base, x -> x.label))), ',') AS base_labels",
        "array_join(array_sort(array_distinct(concat(transform(base, x -> x.label), transform(matched, x -> x.label)))), ',') AS labels",
        "CASE WHEN size(base) + size(matched) = 0 THEN 0.0D ELSE 1.0D - 1.0D / (1 + size(base) + aggregate(matched, 0, (a, x) -> a + x.fixed)) END AS score",
    )


def brute_force(text: str | None) -> tuple:
    """(n_words, n_base, first, last, base labels) of one text; for tests."""
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    return len(ws), len(places), min((p for p, _ in places), default=None), max((p for p, _ in places), default=None), ",".join(sorted({x for _, x in places}))
