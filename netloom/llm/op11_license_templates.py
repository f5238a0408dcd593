"""License scans: template markup compiled into token automata, which accept texts whose mandatory wording matches exactly.

A template is a label and its text with markup: words outside of markup are mandatory; ``<<beginOptional>>`` to
``<<endOptional>>`` (nested as deep as wanted) may be missing; ``<<var;match="...">>`` is replaceable, by one of several
wordings (``match="licensed|released under"``) or by a number of any words (``match=".{2,40}"``; ``.+`` and ``.*`` stand
for up to ``most_words``). Further fields of a variable (name, original) are for readers. Wording is compared by words,
A-Z lower-cased, so punctuation and layout don't count.

A template becomes an automaton whose edges are words or "any word". A text is scanned where it is read, without a
shuffle: all of its word pairs are hashed, and the automata start only at pairs (or single words) that one of them can
begin with; there they are run word by word, so hashes decide nothing. From each start an automaton reports its longest
accepted end. Templates that may begin with "any word", or accept nothing at all, are refused.

A match's score is e / (e + 4), where e is the number of mandatory words matched; a document's is its best match's.

Defined cases: a null text is empty, and has no matches; rows are judged one by one, with or without an id; texts longer
than an Arrow slice come alone; ``scan`` keeps further columns (one of the names it adds is replaced); an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm import textvec as tv
from netloom.llm.arrowio import add_columns, column

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r'<<(beginOptional|endOptional|var)(?:;((?:"[^"]*"|[^>"])*))?>>')
_MATCH = re.compile(r'match="([^"]*)"')
_COUNT = re.compile(r"\.(?:\{(\d+),(\d+)\}|([+*]))")
_PAIR_SALT = 0x11CE
FIELDS = ("n_words", "matches")
_TYPES = ("long", "array<struct<label:string,base:boolean,from_word:int,to_word:int,mandatory:int>>")

#: Phrases whose places are counted, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_HOLDER = '<<beginOptional>>Copyright <<beginOptional>>(c)<<endOptional>> <<var;name="copyright";match=".{1,40}">><<endOptional>>'
_GRANTED = '<<var;name="verb";match="licensed|released|distributed|published|available|provided|made available|licensed to you">>'
_NO_WARRANTY = 'WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holder";match="THE|.{1,20}">> AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY <<var;name="holder";match=".{1,20}">> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_GNU = 'This <<var;name="work";match="program|library|software|file|work|project|package|module|script|code">> is free software: you can redistribute it and/or modify it under the terms of the GNU %s as published by the Free Software Foundation, <<beginOptional>>either<<endOptional>> version %s of the License, or (at your option) any later version.'

#: Templates of public licenses and of the notices that name them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", f'<<beginOptional>><<var;name="title";match="The MIT License|MIT License">> <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_HOLDER} Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", {_NO_WARRANTY}'),
    ("MIT", f"{_GRANTED} under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("ISC", f'{_HOLDER} Permission to use, copy, modify, and<<var;name="or";match="|or">> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'),
    ("BSD-2-Clause", f"Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. {_BSD_END}"),
    ("BSD-3-Clause", f'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1.<<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2.<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. <<beginOptional>>3.<<endOptional>> Neither the name of <<var;name="holder";match=".{{1,20}}">> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}'),
    ("Apache-2.0", '<<beginOptional>>Licensed under the Apache License, Version 2.0 (the "License");<<endOptional>> you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;name="address";match=".{3,12}">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", f'{_GRANTED} under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> Apache License<<var;name="version";match="|, Version|, v">> 2.0'),
    ("GPL-2.0-or-later", _GNU % ("General Public License", "2")),
    ("GPL-3.0-or-later", _GNU % ("General Public License", "3")),
    ("LGPL-2.1-or-later", _GNU % ("Lesser General Public License", "2.1")),
    ("AGPL-3.0-or-later", _GNU % ("Affero General Public License", "3")),
    ("GPL-2.0", f'{_GRANTED} under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License<<var;name="version";match="|, version|, v">> 2<<beginOptional>>.0<<endOptional>>'),
    ("GPL-3.0", f'{_GRANTED} under <<beginOptional>>the<<endOptional>> <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>GNU<<endOptional>> General Public License<<var;name="version";match="|, version|, v">> 3<<beginOptional>>.0<<endOptional>>'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    *((f"CC-{kind.upper()}-{version}", f'{_GRANTED} under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> <<var;name="family";match="CC|Creative Commons">> <<var;name="kind";match="{short}|{long}">> {version} <<beginOptional>>International<<endOptional>>') for kind, short, long in (("by", "BY", "Attribution"), ("by-sa", "BY SA", "Attribution ShareAlike|Attribution Share Alike"), ("by-nc", "BY NC", "Attribution NonCommercial|Attribution Non Commercial"), ("by-nd", "BY ND", "Attribution NoDerivatives|Attribution NoDerivs"), ("by-nc-sa", "BY NC SA", "Attribution NonCommercial ShareAlike"), ("by-nc-nd", "BY NC ND", "Attribution NonCommercial NoDerivatives")) for version in ("4.0", "3.0")),
)


def _lower(text: str) -> bytes:
    return bytes(tv.LOWER[np.frombuffer(text.encode(), np.uint8)]) if text else b""


def _words(text: str) -> list[bytes]:
    return _WORD.findall(_lower(text))


@dataclass
class Automaton:
    """States from 0; ``after`` gives each state's edges by word, ``anyway`` its "any word" edges; free edges are gone.

    ``done`` has the states that accept. A state's edges lead to (state, whether the word is mandatory).
    """

    label: str
    base: bool
    after: list[dict[bytes, list[tuple[int, bool]]]]
    anyway: list[list[int]]
    done: frozenset[int]

    @classmethod
    def of(cls, label: str, text: str, *, base: bool = False, most_words: int = 400) -> Automaton:
        free: list[set[int]] = [set()]
        after: list[dict[bytes, list[tuple[int, bool]]]] = [{}]
        anyway: list[list[int]] = [[]]

        def state() -> int:
            free.append(set())
            after.append({})
            anyway.append([])
            return len(free) - 1

        def along(at: int, words: Iterable[bytes], mandatory: bool) -> int:
            for w in words:
                to = state()
                after[at].setdefault(w, []).append((to, mandatory))
                at = to
            return at

        at, place, opened = 0, 0, []
        for mark in [*_MARK.finditer(text), None]:
            at = along(at, _words(text[place : mark.start() if mark else len(text)]), not opened)
            if mark is None:
                break
            place = mark.end()
            if mark[1] == "beginOptional":
                opened.append(at)
            elif mark[1] == "endOptional":
                if not opened:
                    raise ValueError(f"{label}: <<endOptional>> without <<beginOptional>>")
                to = state()
                free[at].add(to)
                free[opened.pop()].add(to)
                at = to
            else:
                found = _MATCH.search(mark[2] or "")
                if not found:
                    raise ValueError(f"{label}: a variable needs match")
                to = state()
                for option in found[1].split("|"):
                    if count := _COUNT.fullmatch(option):
                        low = int(count[1]) if count[1] else int(count[3] == "+")
                        high = int(count[2]) if count[2] else most_words
                        step = at
                        for i in range(high + 1):
                            if i >= low:
                                free[step].add(to)
                            if i < high:
                                following = state()
                                anyway[step].append(following)
                                step = following
                    else:
                        free[along(at, _words(option), False)].add(to)
                at = to
        if opened:
            raise ValueError(f"{label}: <<beginOptional>> without <<endOptional>>")
        return cls(label, base, after, anyway, frozenset([at]))._without_free(free)

    def _without_free(self, free: list[set[int]]) -> Automaton:
        """Each state takes over the edges of all states that free edges lead to."""
        after, anyway, done = [], [], set()
        for s in range(len(free)):
            near, todo = {s}, [s]
            while todo:
                new = free[todo.pop()] - near
                near |= new
                todo += new
            edges: dict[bytes, list[tuple[int, bool]]] = {}
            for t in sorted(near):
                for w, to in self.after[t].items():
                    edges.setdefault(w, []).extend(to)
            after.append(edges)
            anyway.append([to for t in sorted(near) for to in self.anyway[t]])
            if near & self.done:
                done.add(s)
        if anyway[0] or 0 in done or not after[0]:
            raise ValueError(f"{self.label}: a template must begin with a word")
        return Automaton(self.label, self.base, after, anyway, frozenset(done))

    def beginnings(self) -> tuple[set[tuple[bytes, bytes]], set[bytes]]:
        """Pairs of words that can begin a match, and words after which anything or nothing may come."""
        pairs, single = set(), set()
        for w, to in self.after[0].items():
            for s, _ in to:
                if self.anyway[s] or s in self.done:
                    single.add(w)
                pairs |= {(w, second) for second in self.after[s]}
        return pairs, single

    def longest(self, word, at: int, end: int) -> tuple[int, int] | None:
        """End and mandatory words of the longest match that begins at a word; ``word`` gives the i-th of ``end``."""
        states, found = {0: 0}, None  # state: most mandatory words on a way to it
        while states and at < end:
            w, reached = word(at), {}
            for s, n in states.items():
                for to, mandatory in self.after[s].get(w, ()):
                    reached[to] = max(reached.get(to, 0), n + mandatory)
                for to in self.anyway[s]:
                    reached[to] = max(reached.get(to, 0), n)
            states, at = reached, at + 1
            if over := [n for s, n in states.items() if s in self.done]:
                found = at, max(over)
        return found


class Scanner:
    """All automata, and which of them can begin with which pair or word."""

    def __init__(self, templates: Iterable[tuple[str, str]], phrases: dict[str, str], most_words: int = 400):
        self.automata = [Automaton.of(label, phrase, base=True) for phrase, label in phrases.items()] + [Automaton.of(label, text, most_words=most_words) for label, text in templates]
        self.pairs: dict[tuple[bytes, bytes], list[int]] = {}
        self.singles: dict[bytes, list[int]] = {}
        for i, a in enumerate(self.automata):
            pairs, single = a.beginnings()
            for p in pairs:
                self.pairs.setdefault(p, []).append(i)
            for w in single:
                self.singles.setdefault(w, []).append(i)
        first, second = (self._hashes([p[k] for p in self.pairs]) for k in (0, 1))
        self.pair_hashes = np.unique(tv.mix(first, _PAIR_SALT) + second)
        self.single_hashes = np.unique(self._hashes(list(self.singles)))

    @staticmethod
    def _hashes(words: list[bytes]) -> np.ndarray:
        ends = np.cumsum([0, *map(len, words)])
        return tv.word_hashes(np.frombuffer(b"".join(words), np.uint8), ends[:-1], ends[1:])

    def find(self, texts) -> tuple[np.ndarray, list[list[tuple]]]:
        """Words before each text, and each text's matches: (from, to, automaton, mandatory words), in order."""
        data, offsets = tv.as_bytes(texts)
        data = tv.LOWER[data]
        starts, ends, at = tv.words(data, offsets, tv.NOT_ALNUM)
        hashes = tv.word_hashes(data, starts, ends)
        maybe = np.zeros(len(starts), bool)
        if len(starts):
            maybe[:-1] = _among(tv.mix(hashes[:-1], _PAIR_SALT) + hashes[1:], self.pair_hashes)
            maybe |= _among(hashes, self.single_hashes)
        out: list[list[tuple]] = [[] for _ in range(len(at) - 1)]
        places = np.flatnonzero(maybe)
        word = lambda i: data[starts[i] : ends[i]].tobytes()
        for i, doc in zip(places.tolist(), (np.searchsorted(at, places, "right") - 1).tolist(), strict=True):
            first, last = word(i), int(at[doc + 1])
            able = set(self.singles.get(first, ()))
            if i + 1 < last:
                able |= set(self.pairs.get((first, word(i + 1)), ()))
            for a in sorted(able):
                if found := self.automata[a].longest(word, i, last):
                    out[doc].append((i - int(at[doc]), found[0] - int(at[doc]), a, found[1]))
        return at, out


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def scan(docs: DataFrame, *, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] | None = None, most_words: int = 400, names: tuple[str, str] = FIELDS) -> DataFrame:
    """docs with n_words and matches: label, whether a base phrase, word range and mandatory words of every match.

    What is broadcast are the templates.
    """
    scanner = Scanner(templates, BASE if phrases is None else phrases, most_words)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    struct = [("label", pa.string()), ("base", pa.bool_()), ("from_word", pa.int32()), ("to_word", pa.int32()), ("mandatory", pa.int32())]

    def fn(piece: pa.RecordBatch) -> list:
        at, found = shared.value.find(column(piece, "text"))
        automata = shared.value.automata
        rows = [[{"label": automata[a].label, "base": automata[a].base, "from_word": i, "to_word": j, "mandatory": n} for i, j, a, n in own] for own in found]
        return [pa.array(np.diff(at)), pa.array(rows, pa.list_(pa.struct(struct)))]

    return add_columns(docs, ", ".join(f"`{n}` {t}" for n, t in zip(names, _TYPES, strict=True)), fn)


def op11_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["base"])
    start = lambda m: m["from_word"].cast("long")
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["mandatory"])), F.lit(0)).cast("double")
    columns = {"n_base": F.size(base).cast("long"), "first_word": F.array_min(F.transform(base, start)), "last_word": F.array_max(F.transform(base, start)), "base_labels": labels(base), "labels": labels(F.col("matches")), "score": best / (best + 4)}
    return found.withColumns(columns).select("doc_id", "n_words", *columns)
