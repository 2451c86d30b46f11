"""License scan by a generalised suffix automaton of license tokens (operator 4).

The automaton of all templates' words is small and fixed, so every task builds its own.  Words
stream through it: the matching statistic at a word is the longest stretch ending there that
occurs in any template.  Every template's own longest parts of the maximal stretches are placed
in it and chained in order; the share of a template that its best chain covers decides on the template's label, and so
does the share of the words that tell it from other templates.
Base phrases are found in the same pass, as the automaton's states that have them as a suffix.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from passgrid.llm.common import col

# Base phrases and their labels.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Well-known sentences and bodies of licenses and the labels the scan adds for them.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-3", "GNU General Public License, version 3."),
    ("gpl-2", "GNU General Public License, version 2."),
    ("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("bsd-3-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

#: ASCII to lower case; what separates words to a blank.  Bytes of other characters are word bytes.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split(b" ")


def split_words(text: str) -> list[bytes]:
    return [w for w in words_of(text) if w]


class Automaton:
    """Suffix automaton of several word sequences, built one after the other from the start state."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.places: list[set[tuple[int, int]]] = [set()]  # (template, word after the last) where the state ends
        self.origin: list[tuple[int, int] | None] = [None]  # one place of the state, in a template or a phrase
        self.ids: dict[bytes, int] = {}
        self.templates = [(label, [self.ids.setdefault(w, len(self.ids)) for w in split_words(text)]) for label, text in templates]
        base = [(label, [self.ids.setdefault(w, len(self.ids)) for w in split_words(text)]) for text, label in phrases.items()]
        self.sequences = [words for _, words in [*self.templates, *base]]
        for number, words in enumerate(self.sequences):
            state = 0
            for at, word in enumerate(words):
                state = self._extend(state, word)
                self.origin[state] = number, at + 1
                if number < len(self.templates):
                    self.places[state].add((number, at + 1))
        self.parts: dict[tuple[int, int, int], list[tuple[int, int, int, int]]] = {}
        self.telling = [self._telling(number) for number in range(len(self.templates))]
        # Places and base phrases of longer states hold for the states they link to, and the other way about for phrases.
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.places[self.link[state]] |= self.places[state]
                self.origin[self.link[state]] = self.origin[self.link[state]] or self.origin[state]
        ends = defaultdict(list)
        for label, words in base:
            state = 0
            for word in words:
                state = self.next[state][word]
            ends[state].append((len(words), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.length]
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            self.phrases[state] = ends[state] + self.phrases[max(0, self.link[state])]

    def _telling(self, number: int) -> list[int]:
        """How many of a template's first words tell it apart, for every number of words.

        Those are its words outside the longest stretch that it shares with a template of another label
        (one that holds it whole does not count: both are meant then).
        """
        label, words = self.templates[number]
        most, at = 0, 0
        for other, theirs in self.templates:
            if other == label:
                continue
            size, best, end = [0] * (len(theirs) + 1), 0, 0
            for i, word in enumerate(words, 1):
                for j in range(len(theirs), 0, -1):
                    size[j] = size[j - 1] + 1 if theirs[j - 1] == word else 0
                    if size[j] > best:
                        best, end = size[j], i
            if most < best < len(words):
                most, at = best, end
        return [0, *accumulate(int(not at - most <= i < at) for i in range(len(words)))]

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.places.append(set())
        self.origin.append(None)
        return len(self.length) - 1

    def _split(self, above: int, word: int, target: int) -> int:
        """A copy of ``target`` for the stretches no longer than one word past ``above``."""
        copy = self._state(self.length[above] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while above >= 0 and self.next[above].get(word) == target:
            self.next[above][word] = copy
            above = self.link[above]
        return copy

    def _extend(self, last: int, word: int) -> int:
        target = self.next[last].get(word)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        if last >= 0:
            target = self.next[last][word]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
        """Base places as (start, end, label); maximal stretches as (end word, length, state)."""
        base, stretches = [], []
        state = length = 0
        nexts, links, lengths = self.next, self.link, self.length
        known, previous = self.ids, -2
        for at, word in [(i, known[w]) for i, w in enumerate(words) if w in known]:
            if at != previous + 1 and length:  # unknown words stand between
                stretches.append((previous + 1, length, state))
                state = length = 0
            grown = nexts[state].get(word)
            if grown is None:
                if length:
                    stretches.append((at, length, state))
                while state > 0 and word not in nexts[state]:
                    state = links[state]
                    length = lengths[state]
                grown = nexts[state].get(word)
            if grown is None:
                state = length = 0
            else:
                state, length = grown, length + 1
                for size, label in self.phrases[state]:
                    if size <= length:
                        base.append((at + 1 - size, at + 1, label))
            previous = at
        if length:
            stretches.append((previous + 1, length, state))
        return base, stretches

    def placed(self, state: int, length: int, least: int) -> list[tuple[int, int, int, int]]:
        """The longest parts that a stretch shares with each template: (words before the stretch's end, template, word after the last, words).

        The stretch's prefixes are run through the automaton again; the states that a prefix's state
        links to have its suffixes, which occur in more templates.  A stretch is a part of a template
        or phrase, so the answers are few and are kept.
        """
        known = self.parts.get((state, length, least))
        if known is None:
            number, at = self.origin[state]
            words = self.sequences[number][at - length : at]
            runs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)  # by template and diagonal: (end, words)
            now = 0
            for end, word in enumerate(words, 1):
                now = self.next[now][word]
                state_, seen = now, set()
                size = end
                while state_ > 0 and size >= least:
                    for place in self.places[state_] - seen:
                        runs[place[0], place[1] - end].append((end, size))
                    seen |= self.places[state_]
                    state_ = self.link[state_]
                    size = self.length[state_]
            known = self.parts[state, length, least] = []
            for (t, shift), ends in runs.items():
                for (end, size), after in zip(ends, [*ends[1:], (0, 0)], strict=True):
                    if after != (end + 1, size + 1):  # the part does not go on
                        known.append((length - end, t, end + shift, size))
        return known

    def spans(self, stretches: list[tuple[int, int, int]], least: int, gap: int) -> list[tuple[int, int, int, float, float]]:
        """Best chains as (template, first word, end word, share of the template that is covered, share of its telling words).

        Stretches of at least ``least`` words follow each other in a chain if they do so in the
        text and in the template, at most ``gap`` words apart in either.
        """
        parts: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
        for end, length, state in stretches:
            if length >= least:
                for before, template, at, n in self.placed(state, length, least):
                    own = parts[template]
                    own[end - before, at] = max(n, own.get((end - before, at), 0))
        out = []
        for template, own in parts.items():
            size = len(self.templates[template][1])
            anchors = sorted((end, at, n) for (end, at), n in own.items())
            telling = self.telling[template]
            covered, begin, told, low = [], [], [], 0
            for i, (end, at, length) in enumerate(anchors):
                start, own_words = end - length, telling[at] - telling[at - length]
                most = length, own_words
                while anchors[low][0] < end - length - gap:
                    low += 1
                for j in range(low, i):
                    e, a, _ = anchors[j]
                    if e <= end - length and 0 <= at - length - a <= gap and (covered[j] + length, told[j] + own_words) > most:
                        most, start = (covered[j] + length, told[j] + own_words), begin[j]
                covered.append(most[0])
                told.append(most[1])
                begin.append(start)
            out += [(template, b, e, min(1.0, c / size), k / telling[-1] if telling[-1] else 1.0) for (e, _, _), c, b, k in zip(anchors, covered, begin, told, strict=True)]
        return out


@lru_cache(4)
def automaton(templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]) -> Automaton:
    return Automaton(list(templates), dict(phrases))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, span_start long, span_end long, spans string"


def apart(found: list[tuple[int, int, int, float, float]]) -> list[tuple[int, int, int, float, float]]:
    """Of each template's spans the best ones that do not overlap, by place."""
    kept: list[tuple[int, int, int, float, float]] = []
    for s in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1])):
        if not any(k[0] == s[0] and k[1] < s[2] and s[1] < k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: (s[1], s[2], s[0]))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] | None = None,
    phrases: dict[str, str] | None = None,
    least: int = 3,
    gap: int = 8,
    covered: float = 0.75,
) -> DataFrame:
    """Base phrases and covered license templates of every whole text.

    Returns a row per input row: doc_id, n_words, n_base, first_word and last_word (smallest and
    largest start of a base phrase, words from 0; null without one), base_labels, labels (base ones
    and those of templates covered to at least ``covered``, their telling words too; distinct, sorted, comma-joined), score
    (largest covered share; 1 with a base phrase), span_start and span_end (words of the best
    covered span; null if no template is covered enough), spans (every covered span as
    "label:start:end", words from 0, end exclusive, by place, comma-joined; a template's own spans do
    not overlap).  A null text is empty; null ids and repeated rows keep a row each; an empty table
    gives none; other columns are ignored.
    """
    fixed = tuple(templates if templates is not None else TEMPLATES), tuple((phrases if phrases is not None else BASE_PHRASES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(*fixed)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []
                base, stretches = own.scan(words)
                spans = own.spans(stretches, least, gap)
                found = [s for s in spans if min(s[3:]) >= covered]
                base_labels = {b[2] for b in base}
                labels = base_labels | {own.templates[s[0]][0] for s in found}
                best = max(found, key=lambda s: (s[3], s[2] - s[1], -s[1]), default=None)
                rows.append((doc_id, len(words), len(base), min((b[0] for b in base), default=None), max((b[0] for b in base), default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 if base else max((s[3] for s in spans), default=0.0), best and best[1], best and best[2], ",".join(f"{own.templates[t][0]}:{a}:{b}" for t, a, b, *_ in apart(found))))
            types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()] + [pa.int64()] * 2 + [pa.string()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, SCHEMA)
