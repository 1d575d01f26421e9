"""Licence scan: a generalised suffix automaton over licence templates, matching statistics, chained spans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# Phrases that alone decide a label.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Openings and key passages of public licences.
TEMPLATES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions",
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met redistributions of source code must retain the above copyright notice this list of "
        "conditions and the following disclaimer",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license or at your option any later "
        "version",
    ),
    ("gpl", "licensed under the gnu general public license version 3"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
    ),
    (
        "cc-by-nc",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("mit", "released under the mit license"),
)

_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def _fold_table() -> bytes:
    """Upper-case ASCII letters become lower-case, all other bytes outside words become a blank."""
    table = bytearray(range(256))
    for code in _SEPARATORS:
        table[code] = ord(" ")
    for code in range(ord("A"), ord("Z") + 1):
        table[code] = code + 32
    return bytes(table)


_FOLD = _fold_table()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    base: bool


class SuffixAutomaton:
    """Recognises every run of words that stands in some template.

    Per state: transitions by word number, suffix link, length of its longest run, and one place
    (template, end) where that run stands.
    """

    def __init__(self, templates: Sequence[Sequence[int]]) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.place = [(-1, -1)]
        for number, words in enumerate(templates):
            last = 0
            for position, word in enumerate(words):
                last = self._extend(last, word, (number, position))

    def _state(self, length: int, place: tuple[int, int]) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        self.place.append(place)
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` that holds only the runs reached over ``state``."""
        copy = self._state(self.length[state] + 1, self.place[target])
        self.next[copy] = dict(self.next[target])
        self.link[copy] = self.link[target]
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int, place: tuple[int, int]) -> int:
        if word in self.next[last]:  # the run is known from an earlier template
            target = self.next[last][word]
            return target if self.length[target] == self.length[last] + 1 else self._split(last, word, target)
        new = self._state(self.length[last] + 1, place)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state < 0:
            self.link[new] = 0
        else:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def statistics(self, words: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and the length of the longest run ending there that stands in a template."""
        state = size = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                size += 1
            else:
                state = size = 0
            yield state, size


class Scanner:
    """Templates ready for scanning; plain data of the size of the templates, sent to every task."""

    def __init__(
        self,
        phrases: Sequence[tuple[str, str]],
        templates: Sequence[tuple[str, str]],
        min_match: int,
        max_gap: int,
        min_cover: float,
    ) -> None:
        self.templates = [Template(label, tuple(words_of(text)), True) for label, text in phrases]
        self.templates += [Template(label, tuple(words_of(text)), False) for label, text in templates]
        self.vocabulary: dict[bytes, int] = {}
        for template in self.templates:
            for word in template.words:
                self.vocabulary.setdefault(word, len(self.vocabulary))
        numbered = [[self.vocabulary[w] for w in t.words] for t in self.templates]
        self.automaton = SuffixAutomaton(numbered)
        self.places = self._all_places(numbered)
        self.ends = self._phrase_ends(numbered)
        self.shortest = min((len(t.words) for t in self.templates), default=0)
        self.shortest = min(self.shortest, min_match)
        self.min_match, self.max_gap, self.min_cover = min_match, max_gap, min_cover

    def _walk(self, words: Sequence[int]) -> Iterator[int]:
        state = 0
        for word in words:
            state = self.automaton.next[state][word]
            yield state

    def _all_places(self, numbered: Sequence[Sequence[int]]) -> dict[int, list[tuple[int, int]]]:
        """By state: every (template, end) where its runs stand. A place belongs to the state of the
        template's prefix and to all states over its suffix links."""
        found: dict[int, list[tuple[int, int]]] = {}
        for number, words in enumerate(numbered):
            for end, state in enumerate(self._walk(words)):
                while state > 0:
                    found.setdefault(state, []).append((number, end))
                    state = self.automaton.link[state]
        return found

    def _phrase_ends(self, numbered: Sequence[Sequence[int]]) -> dict[int, list[tuple[int, int]]]:
        """By state: (length, template) of the phrases that may end there; a phrase ends at a state
        if the state of the phrase is reached over suffix links."""
        own = {}
        for number, words in enumerate(numbered):
            if self.templates[number].base and words:
                own.setdefault([*self._walk(words)][-1], []).append((len(words), number))
        ends = {}
        for state in range(1, len(self.automaton.next)):
            chain, found = state, []
            while chain > 0:
                found += own.get(chain, [])
                chain = self.automaton.link[chain]
            if found:
                ends[state] = found
        return ends

    def scan(self, text: str) -> tuple[int, list[tuple[int, int, str, float, bool]]]:
        """Number of words, and the spans (first word, words, label, covered share of the template, base)."""
        words = words_of(text)
        known = self.vocabulary.get
        ids = [known(w, -1) for w in words]
        base: list[tuple[int, int, str, float, bool]] = []
        matches: dict[int, list[tuple[int, int, int]]] = {}
        for start, stop in _runs(ids, self.shortest):
            self._run(ids, start, stop, base, matches)
        spans = [span for number, found in matches.items() for span in self._chains(number, found)]
        return len(words), base + spans

    def _run(self, ids, start, stop, base, matches) -> None:
        """Phrases and long maximal matches within one run of template words."""
        last = (0, 0)
        for offset, (state, size) in enumerate(self.automaton.statistics(ids[start:stop])):
            at = start + offset
            for length, number in self.ends.get(state, ()):
                if length <= size:
                    base.append((at - length + 1, length, self.templates[number].label, 1.0, True))
            if last[1] >= self.min_match and size <= last[1]:  # the match that ended before could not grow
                self._note(at - last[1], *last, matches)
            last = (state, size)
        if last[1] >= self.min_match:
            self._note(stop - last[1], *last, matches)

    def _note(self, start: int, state: int, size: int, matches) -> None:
        for number, end in self.places.get(state, ()):
            if not self.templates[number].base and end + 1 >= size:
                matches.setdefault(number, []).append((start, end - size + 1, size))

    def _chains(self, number: int, found) -> Iterator[tuple[int, int, str, float, bool]]:
        """Join matches of one template that follow one another in text and template with small gaps.

        Matches are taken in order of their place. Each continues the open chain that covers most
        and that it can follow; a match that falls behind an open chain starts another. Chains
        that lie more than ``max_gap`` words back are closed, so few are open at a time.
        """
        total = len(self.templates[number].words)
        label = self.templates[number].label
        open_chains: list[list[int]] = []  # first word, end in text, end in template, covered words
        for start, inner, size in sorted(found):
            keep = []
            for chain in open_chains:
                if start - chain[1] > self.max_gap:
                    yield from self._closed(chain, total, label)
                else:
                    keep.append(chain)
            open_chains = keep
            fits = [
                c for c in open_chains
                if c[1] - size < start and c[2] - size < inner <= c[2] + self.max_gap
            ]
            if fits:
                chain = max(fits, key=lambda c: (c[3], -c[0]))
                overlap = max(0, chain[1] - start, chain[2] - inner)
                if overlap < size:
                    chain[3] += size - overlap
                    chain[1], chain[2] = max(chain[1], start + size), max(chain[2], inner + size)
            else:
                open_chains.append([start, start + size, inner + size, size])
        for chain in open_chains:
            yield from self._closed(chain, total, label)

    def _closed(self, chain, total, label) -> Iterator[tuple[int, int, str, float, bool]]:
        share = chain[3] / total
        if share >= self.min_cover:
            yield chain[0], chain[1] - chain[0], label, min(1.0, share), False


def _runs(ids: list[int], shortest: int) -> Iterator[tuple[int, int]]:
    """Stretches of at least ``shortest`` template words; others cannot hold a match."""
    import numpy as np

    if len(ids) < max(1, shortest):
        return
    known = np.array(ids, dtype=np.int32) >= 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
    for start, stop in edges.reshape(-1, 2):
        if stop - start >= shortest:
            yield int(start), int(stop)


SPANS = ArrayType(
    StructType(
        [
            StructField("first_word", LongType()),
            StructField("n_words", LongType()),
            StructField("label", StringType()),
            StructField("cover", DoubleType()),
            StructField("base", StringType()),
        ]
    )
)


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: Sequence[tuple[str, str]] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    min_match: int = 4,
    max_gap: int = 4,
    min_cover: float = 0.6,
) -> DataFrame:
    """Licence mentions of every document, found in one streaming pass without a shuffle.

    ``phrases`` and ``templates`` (label, text) go into one generalised suffix automaton. Each
    document streams through it; the matching statistics give every place where a phrase stands
    and the maximal runs of at least ``min_match`` words that stand in a template. Runs of one
    template that follow one another with gaps of at most ``max_gap`` words are chained into
    spans; a span counts if it covers ``min_cover`` of the template. The matching statistics of a
    word depend on the run of template words around it alone, so other words are passed over.

    Per row: the id, ``n_words``, ``spans`` (first word, words, label, share, ``base`` 'phrase'
    or 'template'), ``labels``, ``base_labels`` (distinct, sorted, comma-joined), ``n_base``,
    ``first_word`` and ``last_word`` of the phrases' places (else null), and ``score``: the
    largest covered share, 1 for a phrase, 0 without any.

    Null texts count as empty. Rows are independent: repeated rows and null ids get a row each.
    Other columns are ignored; an empty table gives no rows.
    """
    source = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("text"))
    scanner = Scanner(phrases, templates, min_match, max_gap, min_cover)
    schema = StructType(
        [
            StructField(id_col, source.schema[id_col].dataType),
            StructField("n_words", LongType()),
            StructField("n_base", LongType()),
            StructField("first_word", LongType()),
            StructField("last_word", LongType()),
            StructField("base_labels", StringType()),
            StructField("labels", StringType()),
            StructField("score", DoubleType()),
            StructField("spans", SPANS),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            kinds = [batch.schema.field(0).type, *[to_arrow_type(f.dataType) for f in schema.fields[1:]]]
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                rows = [_row(*scanner.scan(text or "")) for text in part.column(1).to_pylist()]
                columns = [part.column(0), *[pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:])]]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return source.mapInArrow(run, schema)


def _row(n_words: int, spans: list[tuple[int, int, str, float, bool]]) -> tuple:
    base = [s for s in spans if s[4]]
    listed = [
        {"first_word": s[0], "n_words": s[1], "label": s[2], "cover": s[3], "base": "phrase" if s[4] else "template"}
        for s in sorted(spans)
    ]
    return (
        n_words,
        len(base),
        min((s[0] for s in base), default=None),
        max((s[0] for s in base), default=None),
        ",".join(sorted({s[2] for s in base})),
        ",".join(sorted({s[2] for s in spans})),
        max((s[3] for s in spans), default=0.0),
        listed,
    )
