"""Licence scan: matching statistics of each text against a generalised suffix automaton of licence tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridra.llm.common import slices, text_bytes

# The phrases that label a text by themselves.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Notices as their publishers word them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "Released under the MIT License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)

#: ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts words.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered; null has none."""
    return text_bytes(text).translate(_FOLD).split()


@dataclass(frozen=True)
class LicenseConfig:
    """A match counts from `min_match` words; matches of one template chain across up to `gap` words;
    a template is found when `coverage` of it is covered by a chain."""

    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, str], ...] = TEMPLATES
    min_match: int = 3
    gap: int = 6
    coverage: float = 0.8


class Automaton:
    """Suffix automaton of several token sequences. Each state knows where in which sequence its strings end."""

    def __init__(self, cfg: LicenseConfig):
        self.cfg = cfg
        self.codes: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.sequences = [tokens(t) for _, t in cfg.templates] + [tokens(p) for p, _ in cfg.phrases]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for s, words in enumerate(self.sequences):
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, self.codes.setdefault(w, len(self.codes)))
                self.ends[last].add((s, i))
        for v in sorted(range(1, len(self.len)), key=lambda v: -self.len[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()
        self.places: dict[int, list[tuple[int, int, int]]] = {}
        self.phrases: list[list[tuple[int, int]]] = [[] for _ in self.len]
        first = len(cfg.templates)
        for v in sorted(range(1, len(self.len)), key=self.len.__getitem__):
            own = [(s - first, len(self.sequences[s])) for s, i in self.ends[v] if s >= first and i == len(self.sequences[s]) - 1 and self.len[self.link[v]] < len(self.sequences[s]) <= self.len[v]]
            self.phrases[v] = self.phrases[self.link[v]] + own

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(moves)
        self.ends.append(set())
        return len(self.len) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new, p = self._state(self.len[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def credits(self, state: int) -> list[tuple[int, int, int]]:
        """(template, place in it, longest match) of all template places at which a string of this state or of its suffix links ends."""
        known = self.places.get(state)
        if known is None:
            up = self.link[state]
            above = self.credits(up) if up > 0 and self.len[up] >= self.cfg.min_match else []
            own = {(s, at) for s, at in self.ends[state] if s < len(self.cfg.templates)}
            known = self.places[state] = [(s, at, self.len[state]) for s, at in sorted(own)] + [x for x in above if x[:2] not in own]
        return known

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Places (start, phrase) of the phrases, and every maximal match (last word, template, its last place there, length) of at least
        `min_match` words, in the order of their ends."""
        codes, moves, link, length_of, phrases, least = self.codes, self.next, self.link, self.len, self.phrases, self.cfg.min_match
        places, matches = [], []
        # running matches by (template, place there less place here)
        running: dict[tuple[int, int], int] = {}
        state = length = 0
        for i, w in enumerate(words):
            c = codes.get(w)
            if c is None:
                state = length = 0
            else:
                while state and c not in moves[state]:
                    state = link[state]
                    length = length_of[state]
                if c in moves[state]:
                    state = moves[state][c]
                    length += 1
                for p, k in phrases[state]:
                    if k <= length:
                        places.append((i - k + 1, p))
            now = {(s, at - i): min(length, most) for s, at, most in self.credits(state)} if length >= least else {}
            if running:
                matches += sorted((i - 1, s, d + i - 1, n) for (s, d), n in running.items() if (s, d) not in now)
            running = now
        matches += sorted((len(words) - 1, s, d + len(words) - 1, n) for (s, d), n in running.items())
        return places, matches

    def spans(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Covered spans (template, first word, last word, covered share): of each template's chains the best, and every further one that
        reaches the coverage and overlaps none that is better. Matches are in the order of their ends."""
        chains: dict[int, list[list]] = {}
        for end, s, at, length in matches:
            mine = chains.setdefault(s, [])
            # a chain is [first word, last word, last place in the template, covered words]
            best = [end - length + 1, end, at, length]
            for chain in reversed(mine):
                if end - length - chain[1] > self.cfg.gap:
                    break  # chains' ends ascend, so no earlier one is near enough
                new_words = min(length, end - chain[1], at - chain[2])
                if new_words > 0 and at - length - chain[2] <= self.cfg.gap and chain[3] + new_words > best[3]:
                    best = [chain[0], end, at, chain[3] + new_words]
            mine.append(best)
        out = []
        for s, mine in chains.items():
            size, taken = len(self.sequences[s]), []
            enough = [c for c in mine if c[3] >= self.cfg.coverage * size] or [min(mine, key=lambda c: (-c[3], c[0], c[1]))]
            for c in sorted(enough, key=lambda c: (-c[3], c[0], c[1])):
                if all(c[1] < lo or hi < c[0] for lo, hi in taken):
                    taken.append((c[0], c[1]))
                    out.append((s, c[0], c[1], min(1.0, c[3] / size)))
        return out


@lru_cache(maxsize=2)
def automaton(cfg: LicenseConfig) -> Automaton:
    return Automaton(cfg)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: LicenseConfig = LicenseConfig()) -> DataFrame:
    """Licence labels of every whole text, one row per row:
    (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    `n_base` counts the places of the phrases, `first_word`/`last_word` are the smallest and largest start. `labels`
    adds those of the templates that are covered well enough; `spans` lists every such place as label:first-last. `score` is the
    largest covered share, 1 with a phrase. Null or wordless text has no labels and score 0. Repeated rows give equal
    rows, an empty table none; other columns are not looked at. The texts stay where they are: no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton(cfg)
        for batch in batches:
            for piece in slices(batch, 1000, 1):
                rows = []
                for text in piece.column(1):
                    words = tokens(text.as_py())
                    places, matches = a.scan(words)
                    spans = a.spans(matches) if matches else []
                    base = {cfg.phrases[p][1] for _, p in places}
                    found = [(cfg.templates[s][0], lo, hi) for s, lo, hi, share in spans if share >= cfg.coverage]
                    score = 1.0 if places else max((share for *_, share in spans), default=0.0)
                    starts = [i for i, _ in places]
                    rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {x for x, *_ in found})), score, ",".join(f"{x}:{lo}-{hi}" for x, lo, hi in sorted(found))))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([piece.column(0), *columns], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
