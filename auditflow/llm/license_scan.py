"""License scan with a generalised suffix automaton over the words of license templates.

A text is streamed word by word through the automaton. It gives matching statistics: for each word
the longest stretch ending there that is part of some template, and which template places it fits.
Maximal matches that are long enough are chained, in order and with small gaps, into spans, and a
span counts when it covers enough of its template. Whole occurrences of short phrases come out of
the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Phrases whose every occurrence is reported, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Openings and notices of public licenses, with their labels.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
     "documentation files the software to deal in the software without restriction including without limitation the "
     "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
     "persons to whom the software is furnished to do so subject to the following conditions", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the "
     "license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache-2"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
     "an as is basis without warranties or conditions of any kind either express or implied", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
     "license as published by the free software foundation either version 3 of the license or at your option any later "
     "version", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the "
     "following conditions are met", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
)

#: Words are runs of ASCII digits, ASCII letters and everything beyond ASCII; A-Z are lowered.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


class TemplateAutomaton:
    """Generalised suffix automaton of word sequences; states know where in which template they end."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.ends[self.link[state]] |= self.ends[state]
        self.ends[0] = set()

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, source: int, target: int, word: int) -> int:
        """The state for the shorter strings of ``target``, which ``source`` reaches by ``word``."""
        if self.length[target] == self.length[source] + 1:
            return target
        copy = self._add(self.length[source] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while source >= 0 and self.next[source].get(word) == target:
            self.next[source][word] = copy
            source = self.link[source]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:  # an earlier template has this stretch
            return self._split(last, self.next[last][word], word)
        new = self._add(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, self.next[state][word], word)
        return new


@dataclass(frozen=True)
class Span:
    """Words ``start`` to ``end`` (exclusive) of a text cover ``coverage`` of a template."""

    template: int
    start: int
    end: int
    coverage: float


class Scanner:
    def __init__(self, phrases=PHRASES, templates=TEMPLATES, *, min_match: int = 4, max_gap: int = 12, min_coverage: float = 0.75):
        self.min_match, self.max_gap, self.min_coverage = min_match, max_gap, min_coverage
        self.labels = [label for _, label in (*templates, *phrases)]
        sequences = [words_of(t.encode()) for t, _ in (*templates, *phrases)]
        self.ids: Mapping[bytes, int] = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
        coded = [[self.ids[w] for w in s] for s in sequences]
        self.sizes = [len(s) for s in coded]
        self.phrases = range(len(templates), len(coded))
        self.automaton = TemplateAutomaton(coded)
        #: By state: the phrases that end there as a whole, if the match is as long as they are.
        last = {p: self.sizes[p] - 1 for p in self.phrases}
        self.whole: list[set[int]] = [
            {p for p, place in ends if last.get(p) == place and self.sizes[p] <= length}
            for ends, length in zip(self.automaton.ends, self.automaton.length, strict=True)
        ]
        for state in sorted(range(1, len(self.whole)), key=self.automaton.length.__getitem__):
            self.whole[state] |= self.whole[self.automaton.link[state]]  # what ends a longer match ends with it
        self.shortest = min([self.min_match, *(self.sizes[p] for p in self.phrases)])

    def statistics(self, ids: Sequence[int]) -> Iterator[tuple[int, int]]:
        """State and match length after each word."""
        moves, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state, matched = 0, 0
        for word in ids:
            while state and word not in moves[state]:
                state = link[state]
                matched = length[state]
            if word in moves[state]:
                state = moves[state][word]
                matched += 1
            yield state, matched

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, int]], list[Span]]:
        """(phrase, start) of all whole phrases, and the covered template spans."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        known = np.concatenate(([0], (ids > 0).view(np.int8), [0]))
        edges = np.flatnonzero(np.diff(known))
        found: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []  # start, end, state
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a < self.shortest:
                continue
            run = list(self.statistics(ids[a:b].tolist()))
            for i, (state, matched) in enumerate(run):
                found += [(p, a + i + 1 - self.sizes[p]) for p in self.whole[state] if matched >= self.sizes[p]]
                if matched >= self.min_match and (i + 1 == len(run) or run[i + 1][1] <= matched):
                    matches.append((a + i + 1 - matched, a + i + 1, state))
        return found, self._chain(matches)

    def _chain(self, matches: list[tuple[int, int, int]]) -> list[Span]:
        """Join matches of a template that follow each other in it and in the text."""
        open_: dict[int, list[int]] = {}  # template: start, end, place of the last word, words covered
        spans: list[Span] = []

        def close(template: int) -> None:
            start, end, _, covered = open_.pop(template)
            if covered >= self.min_coverage * self.sizes[template]:
                spans.append(Span(template, start, end, covered / self.sizes[template]))

        for start, end, state in matches:
            places: dict[int, list[int]] = {}
            for template, place in self.automaton.ends[state]:
                places.setdefault(template, []).append(place)
            for template, ends in places.items():
                if template in self.phrases:
                    continue
                if template in open_:
                    first, so_far, at, covered = open_[template]
                    ahead = [p for p in ends if p > at]
                    if ahead and start - so_far <= self.max_gap:
                        place = min(ahead)
                        new = min(place - at, end - max(start, so_far), end - start)
                        if new > 0:
                            open_[template] = [first, end, place, covered + new]
                        continue
                    close(template)
                open_[template] = [start, end, min(ends), end - start]
        for template in list(open_):
            close(template)
        return sorted(spans, key=lambda s: (s.start, s.end, s.template))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long, coverage: double>>"
)


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Phrases, labels, score and covered template spans of every row's whole text.

    ``score`` is 1 where a whole phrase stands, else the best coverage of a span, 0 without one.
    Null and empty texts have no words, null places and empty labels. Rows are independent, so
    repeated rows and identifiers, and rows without one, all give a row; other columns aren't read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())])
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for text in batch.column(1).cast(pa.binary()):
                words = words_of(text.as_py())
                found, spans = scanner.scan(words)
                starts = [start for _, start in found]
                base = {scanner.labels[p] for p, _ in found}
                more = base | {scanner.labels[s.template] for s in spans}
                score = 1.0 if found else max([0.0, *(s.coverage for s in spans)])
                row = (
                    len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(more)), min(1.0, score),
                    [{"label": scanner.labels[s.template], "start": s.start, "end": s.end, "coverage": s.coverage} for s in spans],
                )
                for values, value in zip(out, row, strict=True):
                    values.append(value)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(span)]
            arrays = [batch.column(0), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SCHEMA.split(", ")[:9]])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(rows, SCHEMA)
