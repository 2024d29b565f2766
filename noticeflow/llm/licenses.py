"""License scans with a generalised suffix automaton of template tokens.

The automaton holds every run of words of every template. A text is streamed through it: after
each word it gives the longest run of template words that ends there (matching statistics). Runs
that cannot grow are chained per label, in the order of text and template, into covered spans; the
covered share of the template is the score. Siblings (``FAMILIES``) share most words: a span counts if
it holds exactly those telling words that its template has, and where siblings overlap the best covered
one stays. Base phrases are labels as they are ("general public license" in an LGPL text, too). The base phrases are states of the same automaton: a
phrase stands at a word if its state is an ancestor of the current one. Words that cannot start or
continue a long run (their pair with the next word is in no template) are skipped by a table
lookup, so only a small part of a text is streamed in Python.

Defined cases: null or empty text has no words, null positions and score 0; repeated rows are
scanned each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from noticeflow.llm.batches import bytes_of, slices, split, text_from, travels

#: Base phrases. Fixed values.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public licence texts, notices and the short statements that point to them. Fixed values.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-nd", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0", "Licensed under CC0 1.0 Universal."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)
LEAST = 5  # words of a run that counts
GAP = 16  # words that may stand between two runs of a chain
COVERED = 0.6  # share of a template that names its label

#: Licences that share most of their words, and the words that tell them apart. Fixed values.
FAMILIES = (
    ({"cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc", "cc-by-nc-sa", "cc-by-nc-nd"}, ("noncommercial", "nc", "sharealike", "sa", "noderivatives", "nd")),
    ({"gpl", "lgpl", "agpl"}, ("lesser", "affero")),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, stop: long, share: double>>"

_TO_WORDS = np.array([c if chr(c).isdigit() or c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)
_TO_WORDS[[i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)]] = 32


def words_of(text: pa.Array):
    """Lower-cased words: letters, digits and everything beyond ASCII."""
    offsets, raw = bytes_of(text)
    return split(text_from(offsets, _TO_WORDS[raw]))


class Automaton:
    """Generalised suffix automaton over numbered words."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, self.ends = [-1], [0], [{}]
        self.number: dict[str, int] = {}
        self.labels = [label for label, _ in templates]
        self.sizes, pairs = [], set()
        for t, (_, text) in enumerate(templates):
            own = self._numbers(text)
            self.sizes.append(len(own))
            pairs.update(zip(own, own[1:], strict=False))
            last = 0
            for i, w in enumerate(own):
                last = self._extend(last, w)
                self.ends[last].setdefault(t, i)
        self.phrases = [(label, self._numbers(p)) for p, label in phrases]
        marks: list[tuple[int, int]] = []
        for k, (_, own) in enumerate(self.phrases):
            last = 0
            for w in own:
                last = self._extend(last, w)
            marks.append((last, k))
            pairs.update(zip(own, own[1:], strict=False))
        self.spoken: list[list[int]] = [[] for _ in self.link]
        for state, k in marks:
            self.spoken[state].append(k)
        for v in sorted(range(1, len(self.link)), key=lambda v: self.len[v]):
            self.spoken[v] = self.spoken[v] + [k for k in self.spoken[self.link[v]] if k not in self.spoken[v]]
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.len[v]):  # ends of a run are ends of its suffixes
            for t, i in self.ends[v].items():
                self.ends[self.link[v]].setdefault(t, i)
        size = len(self.number) + 1
        telling = [next((words for labels, words in FAMILIES if label in labels), ()) for label in self.labels]
        self.family = [next((k for k, (labels, _) in enumerate(FAMILIES) if label in labels), -1) for label in self.labels]
        self.told = [{self.number[w] for w in words if w in self.number} for words in telling]
        self.needs = [told & set(self._numbers(text)) for told, (_, text) in zip(self.told, templates, strict=True)]
        self.pair = np.zeros((size, size), bool)
        for a, b in pairs:
            self.pair[a, b] = True
        self.heads = np.zeros((size, size), bool)
        for _, own in self.phrases:
            self.heads[own[0], own[1]] = True

    def _numbers(self, text: str) -> list[int]:
        words = words_of(pa.array([text], pa.large_string()))
        return [self.number.setdefault(words.vocabulary[i], len(self.number) + 1) for i in words.ids]

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.len.append(length)
        self.ends.append({})
        return len(self.link) - 1

    def _extend(self, last: int, w: int) -> int:
        have = self.next[last].get(w)
        if have is not None and self.len[have] == self.len[last] + 1:
            return have
        new = -1 if have is not None else self._state(self.len[last] + 1, 0, {})
        p, q = last, have
        if have is None:
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                return new
            q = self.next[p][w]
            if self.len[q] == self.len[p] + 1:
                self.link[new] = q
                return new
        clone = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.ends[clone] = dict(self.ends[q])
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        self.link[q] = clone
        if new >= 0:
            self.link[new] = clone
            return new
        return clone

    def stream(self, numbers: list[int]):
        """(phrases, runs): (word, phrase) and maximal (start, stop, state) of one stretch."""
        said, runs = [], []
        state = length = 0
        for i, w in enumerate(numbers):
            before = (state, length)
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state, length = self.next[state][w], length + 1
            else:
                state = length = 0
            if before[1] >= LEAST and length != before[1] + 1:
                runs.append((i - before[1], i, before[0]))
            for k in self.spoken[state]:
                size = len(self.phrases[k][1])
                if length >= size:
                    said.append((i - size + 1, k))
        if length >= LEAST:
            runs.append((len(numbers) - length, len(numbers), state))
        return said, runs


def chains(automaton: Automaton, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
    """(template, start, stop, share of the template) of chained runs."""
    open_: dict[int, list[int]] = {}
    found = []

    def close(t: int) -> None:
        start, stop, _, words = open_.pop(t)
        found.append((t, start, stop, min(1.0, words / automaton.sizes[t])))

    for start, stop, state in runs:
        for t, end in automaton.ends[state].items():
            begin = end - (stop - start) + 1
            have = open_.get(t)
            if have and (start - have[1] > GAP or begin < have[2]):
                close(t)
                have = None
            if have:
                own = stop - max(start, have[1])
                open_[t] = [have[0], max(stop, have[1]), end, have[3] + max(0, own)]
            else:
                open_[t] = [start, stop, end, stop - start]
    for t in list(open_):
        close(t)
    return found


def named(automaton: Automaton, runs: list[tuple[int, int, int]], ids: np.ndarray, covered: float) -> list[tuple[str, int, int, float]]:
    """(label, start, stop, share) of the spans that name a label, in the order of the text."""
    kept: list[tuple[int, int, int, float]] = []
    found = [c for c in chains(automaton, runs) if c[3] >= covered and automaton.told[c[0]].intersection(ids[c[1] : c[2]].tolist()) == automaton.needs[c[0]]]
    for t, start, stop, share in sorted(found, key=lambda c: (-c[3], c[1] - c[2], c[1], c[0])):
        siblings = (k for k in kept if automaton.family[k[0]] == automaton.family[t] >= 0 and automaton.labels[k[0]] != automaton.labels[t])
        if not any(start < k[2] and k[1] < stop for k in siblings):
            kept.append((t, start, stop, share))
    return sorted(((automaton.labels[t], *rest) for t, *rest in kept), key=lambda c: (c[1], c[2], c[0]))


def _scan(templates, phrases, covered):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(templates, phrases)
        for rows, text in slices(batches):
            words = words_of(text)
            n = len(text)
            ids = np.fromiter((automaton.number.get(w, 0) for w in words.vocabulary), np.int64, len(words.vocabulary))[words.ids] if len(words.ids) else np.zeros(0, np.int64)
            said: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            runs: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
            if len(ids) > 1:
                joined = automaton.pair[ids[:-1], ids[1:]]
                joined[words.starts[(words.starts > 0) & (words.starts < len(ids))] - 1] = False
                edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
                starts, stops = edges[::2], edges[1::2] + 1  # words [start, stop)
                head = np.concatenate(([0], np.cumsum(automaton.heads[ids[:-1], ids[1:]])))
                take = (stops - starts >= LEAST) | (head[stops - 1] > head[starts])
                docs = np.searchsorted(words.starts, starts[take], side="right") - 1
                for a, b, d in zip(starts[take].tolist(), stops[take].tolist(), docs.tolist(), strict=True):
                    lead = a - int(words.starts[d])
                    s, r = automaton.stream(ids[a:b].tolist())
                    said[d] += [(i + lead, k) for i, k in s]
                    runs[d] += [(x + lead, y + lead, v) for x, y, v in r]
            columns: list[list] = [[] for _ in range(7)]
            for d in range(n):
                chained = named(automaton, runs[d], ids[words.starts[d] : words.starts[d + 1]], covered) if runs[d] else []
                base = {automaton.phrases[k][0] for _, k in said[d]}
                places = [i for i, _ in said[d]]
                phrase = max((len(automaton.phrases[k][1]) / min(s for s, t in zip(automaton.sizes, automaton.labels, strict=True) if t == automaton.phrases[k][0]) for _, k in said[d]), default=0.0)
                row = (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | {c[0] for c in chained})),
                       max([min(1.0, phrase), *(c[3] for c in chained)]), [{"label": c[0], "start": c[1], "stop": c[2], "share": c[3]} for c in chained])
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])))
            yield pa.record_batch(
                [rows.column("doc_id").cast(pa.int64()), pa.array(np.diff(words.starts), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return scan


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, covered: float = COVERED) -> DataFrame:
    """One row per document: base phrases, labels, covered spans (in words) and the best share."""
    return docs.select("doc_id", "text").mapInArrow(_scan(templates, phrases, covered), SCHEMA)


travels(__name__)
