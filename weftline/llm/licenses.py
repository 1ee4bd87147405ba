"""License scans by template matching (operator 3)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_small_batches, slices, utf8, words

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label to license wording. ``[[...]]`` may be left out; ``{{n}}`` stands for any 0 to n words.
TEMPLATES = {
    "notice:mit": "released under the [[terms of the]] mit license",
    "notice:apache-2.0": "licensed under the apache license [[version 2 0]]",
    "notice:gpl": "licensed under the [[terms of the]] gnu [[lesser]] general public license [[version {{1}}]] [[or any later version]]",
    "text:mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files [[the software]] to deal in the software without restriction including without limitation the rights "
        "to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom "
        "the software is furnished to do so subject to the following conditions {{4}} the above copyright notice and this "
        "permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
    ),
    "text:isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "text:bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
        "conditions are met {{4}} redistributions of source code must retain the above copyright notice this list of conditions "
        "and the following disclaimer {{4}} redistributions in binary form must reproduce the above copyright notice this list of "
        "conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "text:apache-2.0": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at {{12}} unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind"
    ),
    "text:gpl": (
        "this program is free software [[you can redistribute it]] {{8}} you can redistribute it and or modify it under the terms of "
        "the gnu [[lesser]] general public license as published by the free software foundation"
    ),
    "notice:all-rights-reserved": "all rights reserved",
}

_MARKUP = re.compile(r"(\[\[)|(\]\])|\{\{(\d+)\}\}|([^\s\[\]{}]+)")


@dataclass(frozen=True)
class Automaton:
    """States are numbered; the last accepts. From a state: words lead on, any word may lead on, or nothing is read."""

    on_word: tuple[dict[bytes, int], ...]
    on_any: tuple[int, ...]
    free: tuple[tuple[int, ...], ...]
    anchor: bytes  # the longest run of mandatory words, with a space at both ends: a text without it can't match

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in states:
                    states.add(to)
                    todo.append(to)
        return states

    def accepts_at(self, w: list[bytes], at: int) -> bool:
        """Whether some run of words from ``at`` on is the template's wording."""
        last, now = len(self.on_word) - 1, self.closed({0})
        while last not in now and now and at < len(w):
            now = self.closed({to for s in now for to in (self.on_word[s].get(w[at], -1), self.on_any[s]) if to >= 0})
            at += 1
        return last in now

    def first_words(self) -> set[bytes]:
        return {x for s in self.closed({0}) for x in self.on_word[s]}


def compile_template(markup: str) -> Automaton:
    """A template starts with a mandatory word; regions don't nest."""
    on_word: list[dict[bytes, int]] = [{}]
    on_any, free, runs, opened = [-1], [[]], [[]], None

    def state() -> int:
        on_word.append({})
        on_any.append(-1)
        free.append([])
        return len(on_word) - 1

    for begins, ends, most, word in _MARKUP.findall(markup):
        here = len(on_word) - 1
        if begins:
            opened = here
            runs.append([])
        elif ends:
            end = state()
            free[here].append(end)
            free[opened].append(end)
            opened = None
            runs.append([])
        elif most:
            hops = [here, *(state() for _ in range(int(most)))]
            end = state()
            for a, b in zip(hops, hops[1:]):
                on_any[a] = b
            for a in hops:
                free[a].append(end)
            runs.append([])
        else:
            on_word[here][word.encode()] = state()
            if opened is None:
                runs[-1].append(word)
    best = max(runs, key=len)
    return Automaton(tuple(on_word), tuple(on_any), tuple(map(tuple, free)), f" {' '.join(best)} ".encode())


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word positions where the phrase stands in the words joined (and framed) by single spaces."""
    out, at, seen, count = [], line.find(phrase), 0, 0
    while at >= 0:
        count += line.count(b" ", seen, at)
        out.append(count)
        seen = at
        at = line.find(phrase, at + 1)
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License wording in each whole text.

    Columns: the id, ``n_words``, ``n_base`` (places of the base phrases), ``first_word`` and ``last_word`` long (smallest
    and largest start, else null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined), ``score``: 1 if a
    template's wording is there, 0.5 if only a base phrase is, else 0.

    Templates with optional and replaceable regions become token automata that run from each place where their first word
    stands, in texts that hold the longest mandatory run. A null or empty text has no words, no labels ('') and score 0.
    Repeated rows give repeated results, null ids stay, other columns are not read, an empty table gives no rows.
    """
    wanted = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: compile_template(t) for label, t in wanted.items()}
        starts = {label: a.first_words() for label, a in automata.items()}
        base = {f" {p} ".encode(): label for p, label in PHRASES.items()}
        for batch in slices(batches, 1):
            out: list[list] = [[], [], [], [], [], [], []]
            for text in utf8(batch.column(1)):
                w = words(text)
                line = b" " + b" ".join(w) + b" "
                found = {label: at for phrase, label in base.items() if (at := places(line, phrase))}
                at = [p for x in found.values() for p in x]
                more = {
                    label for label, a in automata.items()
                    if a.anchor in line and any(x in starts[label] and a.accepts_at(w, p) for p, x in enumerate(w))
                }
                row = (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found)), ",".join(sorted({*found, *more})), 1.0 if more else 0.5 if found else 0.0)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=names)

    names = [id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return in_small_batches(docs).select(id_col, text_col).mapInArrow(scan, schema)
