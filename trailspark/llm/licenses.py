"""License scan with a generalised suffix automaton of template tokens.

Words of each text are streamed through the automaton, which gives the matching
statistics: at every word the longest suffix that occurs in some template. The
suffix links lead to the shorter suffixes, and each state knows all places of
its words, so every maximal match of at least ``LEAST`` words is found at every
place of every template. For each template the chain that covers most words is
taken: matches that keep the template's order and leave gaps of at most ``GAP``
words become one covered span. A template's coverage is the share of its words
that the span covers; spans of ``COVER`` or of ``LONG`` words give its label,
unless another template's span holds the place and more of its words.

Only ``LEAST`` consecutive words that stand so in a template can begin a match,
so all other words are passed over with array operations. The automaton's size
depends on the templates alone.

Defined results: null and empty texts have no words, labels or spans, score 0;
rows are judged alone, so ties, repeated rows and null ids need nothing; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import ALNUM, Words, scan, slices
from .licence_texts import TEXTS

#: Base phrases and labels (fixed values).
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices of common licences (fixed values, opening or characteristic sentences), and whole texts.
TEMPLATES = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-notice": "Released under the MIT License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-work": "This work is licensed under the GNU General Public License, version 3.",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    **TEXTS,
}
LEAST = 4
GAP = 8
COVER = 0.8
LONG = 12


@dataclass
class Automaton:
    """Suffix automaton of several token sequences; each state knows one place (template, end) of its longest word, and after ``locate`` all."""

    next: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])
    place: list[tuple[int, int]] = field(default_factory=lambda: [(-1, -1)])
    #: State of each prefix, with the prefix's place.
    prefixes: list[tuple[int, tuple[int, int]]] = field(default_factory=list)
    places: list[list[tuple[int, int]]] = field(default_factory=list)

    def _state(self, length: int, link: int, next_: dict[int, int], place: tuple[int, int]) -> int:
        self.next.append(next_)
        self.link.append(link)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's word extended by c, cut off from a longer one if need be."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.place[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, tokens: list[int], template: int) -> None:
        last = 0
        for end, c in enumerate(tokens, 1):
            if c in self.next[last]:
                last = self._split(last, c)
                self.prefixes.append((last, (template, end)))
                continue
            new = self._state(self.length[last] + 1, 0, {}, (template, end))
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, c)
            last = new
            self.prefixes.append((last, (template, end)))

    def locate(self, least: int) -> None:
        """All places of each state that has words of ``least`` tokens: those of its prefixes and of the states linked to it."""
        self.places = [[] for _ in self.length]
        for state, place in self.prefixes:
            while state > 0 and self.length[state] >= least:
                self.places[state].append(place)
                state = self.link[state]

    def suffixes(self, state: int, length: int, least: int) -> dict[tuple[int, int], int]:
        """Place -> length of the longest suffix, of ``least`` tokens or more, of a match that ends there."""
        out: dict[tuple[int, int], int] = {}
        while state > 0 and length >= least:
            for place in self.places[state]:
                out.setdefault(place, length)
            state = self.link[state]
            length = self.length[state]
        return out

    def statistics(self, tokens: list[int]) -> list[tuple[int, int]]:
        """(state, length) of the longest match that ends at each token."""
        out, state, length = [], 0, 0
        for c in tokens:
            while state and c not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if c in self.next[state]:
                state, length = self.next[state][c], length + 1
            else:
                state, length = 0, 0
            out.append((state, length))
        return out


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    """The scanner of ``TEMPLATES``, made once a process."""
    return Scanner()


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None, least: int = LEAST):
        templates = TEMPLATES if templates is None else templates
        self.labels, self.least = list(templates), least
        words = scan(pa.array(list(templates.values()), pa.string()), ALNUM, lower=True)
        self.vocabulary = np.unique(words.hashes)
        code = np.searchsorted(self.vocabulary, words.hashes)
        self.sizes = words.per_row().tolist()
        self.automaton = Automaton()
        self.tokens = [code[words.rows[i] : words.rows[i + 1]].tolist() for i in range(len(self.labels))]
        for i, tokens in enumerate(self.tokens):
            self.automaton.add(tokens, i)
        self.automaton.locate(least)
        # as many words as fit a number without loss
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.gram = min(least, 62 // self.bits)
        grams = [self._grams(np.array(t, dtype=np.int64)) for t in self.tokens]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.int64)
        p = scan(pa.array([x for x, _ in PHRASES], pa.string()), ALNUM, lower=True)
        self.phrases = [p.hashes[p.rows[i] : p.rows[i + 1]] for i in range(len(PHRASES))]

    def _grams(self, code: np.ndarray) -> np.ndarray:
        """Each run of ``gram`` words as one number."""
        n = max(0, len(code) - self.gram + 1)
        out = np.zeros(n, dtype=np.int64)
        for j in range(self.gram):
            out = (out << self.bits) | code[j : j + n]
        return out

    def base(self, w: Words) -> list[tuple[int, int, int]]:
        """(row, word in the row, phrase) of each place."""
        out = []
        for k, phrase in enumerate(self.phrases):
            n = len(w.hashes) - len(phrase) + 1
            if n <= 0:
                continue
            at = np.flatnonzero(w.hashes[:n] == phrase[0])
            for j in range(1, len(phrase)):
                at = at[w.hashes[at + j] == phrase[j]]
            row = np.searchsorted(w.rows, at, "right") - 1
            ok = at + len(phrase) <= w.rows[row + 1]
            out += [(int(r), int(a - w.rows[r]), k) for a, r in zip(at[ok], row[ok], strict=True)]
        return out

    def matches(self, w: Words) -> list[tuple[int, int, int, int, int]]:
        """Maximal matches with each place of each template: (row, first word in the row, length, template, first word in the template)."""
        h = w.hashes
        if len(h) < self.gram or not len(self.grams):
            return []
        code = np.searchsorted(self.vocabulary, h).clip(max=len(self.vocabulary) - 1).astype(np.int64)
        known = self.vocabulary[code] == h
        # a code that no template word has
        grams = self._grams(np.where(known, code, len(self.vocabulary)))
        hit = self.grams[np.searchsorted(self.grams, grams).clip(max=len(self.grams) - 1)] == grams
        word = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(word, np.flatnonzero(hit), 1)
        np.add.at(word, np.flatnonzero(hit) + self.gram, -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(word[:-1]) > 0).astype(np.int8), [0]]))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = e - s >= self.least
        out = []
        for a, b in zip(s[long].tolist(), e[long].tolist(), strict=True):
            r = int(np.searchsorted(w.rows, a, "right")) - 1
            while a < b:
                stop = min(b, int(w.rows[r + 1]))
                if stop - a >= self.least:
                    text = code[a:stop].tolist()
                    for i, (state, n) in enumerate(self.automaton.statistics(text), 1):
                        if n < self.least:
                            continue
                        for (template, end), m in self.automaton.suffixes(state, n, self.least).items():
                            tokens = self.tokens[template]
                            # a match that the next word continues is part of a longer one
                            if i == len(text) or end == len(tokens) or tokens[end] != text[i]:
                                out.append((r, a + i - m - int(w.rows[r]), m, template, end - m))
                a, r = stop, r + 1
        return out

    def spans(self, found: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Chains: (row, first word, end word, template, template words covered)."""
        groups: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row, at, n, template, t_at in found:
            groups.setdefault((row, template), []).append((at, n, t_at))
        out = []
        for (row, template), nodes in groups.items():
            nodes.sort()
            best, before, ends = [], [], {}
            for j, (at, n, t_at) in enumerate(nodes):
                most, last = 0, -1
                for e in range(at - GAP, at + 1):
                    for i in ends.get(e, ()):
                        if best[i] > most and nodes[i][2] + nodes[i][1] <= t_at:
                            most, last = best[i], i
                best.append(most + n)
                before.append(last)
                ends.setdefault(at + n, []).append(j)
            # the chains of most words first; others keep what these leave
            used = bytearray(max(at + n for at, n, _ in nodes))
            for j in sorted(range(len(nodes)), key=lambda j: (-best[j], nodes[j])):
                start = stop = nodes[j][0] + nodes[j][1]
                covered = 0
                while j >= 0 and used.find(1, nodes[j][0], start) < 0:
                    start = nodes[j][0]
                    covered += nodes[j][1]
                    j = before[j]
                if covered:
                    used[start:stop] = b"\1" * (stop - start)
                    out.append((row, start, stop, template, covered))
        return sorted(out)

    def told(self, spans: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Spans of ``COVER`` or ``LONG`` that no other template explains better; a template that stands there word by word is always told."""
        spans = [x for x in spans if x[4] >= LONG or x[4] / self.sizes[x[3]] >= COVER]
        # spans of one template lie apart, so at most one of them holds a given place
        starts: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for row, at, end, template, covered in spans:
            starts.setdefault((row, template), []).append((at, end, covered))
        held: dict[int, list[int]] = {}
        for row, template in starts:
            held.setdefault(row, []).append(template)

        def better(row: int, at: int, end: int, template: int, covered: int) -> bool:
            for other in held[row]:
                mine = starts[row, other]
                i = bisect_right(mine, at, key=lambda x: x[0]) - 1
                if other != template and i >= 0 and mine[i][1] >= end and (mine[i][2], mine[i][2] / self.sizes[other]) > (covered, covered / self.sizes[template]):
                    return True
            return False

        return [x for x in spans if x[2] - x[1] == x[4] == self.sizes[x[3]] or not better(*x)]


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, spans array<struct<label:string,start:long,stop:long,coverage:double>>"
_SPAN = pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())])


def find(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: word count, base places and the template spans (words from 0, end exclusive)."""

    def run(batches):
        own = scanner() if templates is None else Scanner(templates)
        for b in slices(batches, "text"):
            w = scan(b.column("text"), ALNUM, lower=True)
            n = b.num_rows
            places: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            for row, at, k in own.base(w):
                places[row].append((at, k))
            spans: list[list[dict]] = [[] for _ in range(n)]
            for row, at, end, template, covered in own.told(own.spans(own.matches(w))):
                spans[row].append({"label": own.labels[template], "start": at, "stop": end, "coverage": min(1.0, covered / own.sizes[template])})
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(w.per_row()), pa.array([len(p) for p in places], pa.int64()), pa.array([min(p)[0] if p else None for p in places], pa.int64()), pa.array([max(p)[0] if p else None for p in places], pa.int64()),
                    pa.array([sorted({PHRASES[k][1] for _, k in p}) for p in places], pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"],
            )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda x: x["label"]))))
    score = F.greatest(F.when(F.col("n_base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max(F.transform("spans", lambda x: x["coverage"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
