"""Operator 3: licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template. A text's words stream through it; the matching statistic at a
word is the longest run that ends there and stands in some template. Long matches are chained in template order and
the words a chain covers, as a part of the template, are the score; a template covered to LEAST gives its label. A base
phrase stands where the automaton's state, or one on its suffix path, is the phrase's own: each such place counts.

Words of the text are looked up by hash, many documents at once; only runs in which each two neighbours are neighbours
in some template reach the automaton, since no match of two words lies outside such a run.

Edge cases: null or empty text: no words, no labels, score 0. Places never cross documents. Repeated rows each count.
Whole texts stream, whatever their length. Other columns are not looked at. Upper case beyond A-Z is left as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stormgrid.llm import textkit as tk
from stormgrid.llm.shared import project

# Phrases that give a label by themselves, and texts of well-known licences.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
permissions and limitations under the License.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have
received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS
PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "cc-by": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
license, visit http://creativecommons.org/licenses/by/4.0/.""",
    "cc-by-sa": """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a
copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/.""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means.""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any
purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.""",
}
#: A match counts for a chain from so many words; a chain that covers so much of a template gives its label.
MATCH, LEAST = 5, 0.6
#: Words of text that may lie between two matches of a chain.
GAP = 60


def words_of(text: str) -> list[bytes]:
    c = next(tk.chunks([text.encode()], lower=True))
    ws, we, _ = c.words(tk.ALNUM)
    return [c.buf[a:b].tobytes() for a, b in zip(ws, we, strict=True)]


class Automaton:
    """Generalised suffix automaton: states as lists of transitions, longest length, suffix link."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        ends: list[list[tuple[int, int]]] = [[]]
        for k, seq in enumerate(sequences):
            last = 0
            for i, w in enumerate(seq):
                last = self._extend(last, w)
                while len(ends) < len(self.next):
                    ends.append([])
                ends[last].append((k, i))
        order = sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True)
        self.ends = ends  # of each state, (sequence, last word) of every occurrence
        for s in order:
            self.ends[self.link[s]] = self.ends[self.link[s]] + self.ends[s] if self.link[s] > 0 else []

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(dict(nxt))
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """The state for p's longest run followed by w, taken out of q where q's runs are longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.next[q], self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w, self.next[last][w])
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w, self.next[p][w])
        return new

    def step(self, state: int, run: int, w: int) -> tuple[int, int]:
        while state and w not in self.next[state]:
            state = self.link[state]
            run = self.length[state]
        to = self.next[state].get(w)
        return (to, run + 1) if to is not None else (0, 0)


class Scanner:
    def __init__(self) -> None:
        phrases = [words_of(p) for p in PHRASES]
        texts = [words_of(t) for t in TEMPLATES.values()]
        every = sorted({w for s in phrases + texts for w in s})
        number = {w: i for i, w in enumerate(every)}
        self.sequences = [[number[w] for w in s] for s in phrases + texts]
        self.labels = [*PHRASES.values(), *TEMPLATES]
        self.auto = Automaton(self.sequences)
        self.n_phrases = len(phrases)
        c = next(tk.chunks([b" ".join(every)]))
        ws, we, _ = c.words(tk.ALNUM)
        h = tk.span_hash(tk.prefix_hash(c.buf), ws, we)
        order = np.argsort(h)
        self.hash, self.id = h[order], order.astype(np.int32)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[h >> tk.U(48)] = True
        n = len(every)
        self.pair = np.zeros((n, n), bool)
        for s in self.sequences:
            self.pair[s[:-1], s[1:]] = True
        # of each state, phrases that end wherever it is: its own and those on its suffix path
        own = {}
        for k in range(self.n_phrases):
            state = 0
            for w in self.sequences[k]:
                state = self.auto.next[state][w]
            own.setdefault(state, []).append((k, len(self.sequences[k])))
        self.phrases = []
        for s in range(len(self.auto.next)):
            got, p = [], s
            while p > 0:
                got += own.get(p, [])
                p = self.auto.link[p]
            self.phrases.append(got)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Template word numbers of hashed words, -1 for others."""
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.maybe[h >> tk.U(48)])
        i = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[i] == h[at]
        out[at[ok]] = self.id[i[ok]]
        return out

    def stream(self, words: list[int], at: int, places: list, matches: list) -> None:
        """Add base places (first word, phrase) and long matches (first word, words, state) of a run that begins at `at`."""
        state = run = 0
        held = (0, 0)
        for i, w in enumerate(words):
            state, length = self.auto.step(state, run, w)
            if length <= run and run >= MATCH:
                matches.append((at + i - run, run, held[0]))
            run = length
            held = (state, run)
            for k, n in self.phrases[state]:
                if n <= run:
                    places.append((at + i - n + 1, k))
        if run >= MATCH:
            matches.append((at + len(words) - run, run, state))

    def chain(self, matches: list) -> dict[int, tuple[float, int, int]]:
        """Of each template that long matches lie in: the part its best chain covers, and the chain's first and last word."""
        per: dict[int, list] = {}
        for start, n, state in matches:
            for k, end in self.auto.ends[state]:
                if k >= self.n_phrases:
                    per.setdefault(k, []).append((start, end - n + 1, n))
        out = {}
        for k, ms in per.items():
            ms.sort()
            best: list[tuple[int, int]] = []  # covered words, first word
            far = list(accumulate((a + n for a, _, n in ms), max))  # none up to here ends later
            top = (0, 0, 0)
            for i, (a, t, n) in enumerate(ms):
                score, first = n, a
                for j in range(i - 1, -1, -1):
                    if a - far[j] > GAP:
                        break
                    a2, t2, n2 = ms[j]
                    over = max(0, a2 + n2 - a, t2 + n2 - t)
                    if a2 < a and t2 < t and over < n and a - a2 - n2 <= GAP and best[j][0] + n - over > score:
                        score, first = best[j][0] + n - over, best[j][1]
                best.append((score, first))
                top = max(top, (score, first, a + n - 1))
            out[k] = (min(1.0, top[0] / len(self.sequences[k])), top[1], top[2])
        return out


@cache
def scanner() -> Scanner:
    return Scanner()


def scan(texts: pa.Array) -> dict[str, list]:
    s = scanner()
    out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
    for c in tk.chunks(texts, lower=True):
        ws, we, first = c.words(tk.ALNUM)
        ids = s.lookup(tk.span_hash(tk.prefix_hash(c.buf), ws, we))
        two = np.zeros(max(len(ids), 1), bool)  # whether a word and the next are neighbours in a template
        if len(ids) > 1:
            both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            two[both] = s.pair[ids[both], ids[both + 1]]
            cut = first[1:-1] - 1
            two[cut[cut >= 0]] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], two, [False])).astype(np.int8)))
        runs: dict[int, list[tuple[int, int]]] = {}
        doc = np.searchsorted(first, edge[0::2], "right") - 1
        for d, a, b in zip(doc.tolist(), edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            runs.setdefault(d, []).append((a, b + 1))
        for d in range(len(first) - 1):
            lo = int(first[d])
            places: list = []
            matches: list = []
            for a, b in runs.get(d, ()):
                s.stream(ids[a:b].tolist(), a - lo, places, matches)
            chains = s.chain(matches)
            base = sorted({s.labels[k] for _, k in places})
            more = {s.labels[k] for k, v in chains.items() if v[0] >= LEAST}
            out["n_words"].append(int(first[d + 1]) - lo)
            out["n_base"].append(len(places))
            out["first_word"].append(min(places)[0] if places else None)
            out["last_word"].append(max(places)[0] if places else None)
            out["base_labels"].append(",".join(base))
            out["labels"].append(",".join(sorted({*base, *more})))
            out["score"].append(1.0 if places else max((v[0] for v in chains.values()), default=0.0))
            out["spans"].append([{"label": s.labels[k], "first": v[1], "last": v[2], "covered": v[0]} for k, v in sorted(chains.items())])
    return out


_SPAN = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.float64())]))
_TYPES = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": _SPAN}


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and the chains' spans. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scan(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[k], t) for k, t in _TYPES.items())], names=["doc_id", *_TYPES])

    docs = project(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long,covered:double>>")
