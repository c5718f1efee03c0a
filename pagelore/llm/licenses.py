"""License scans: phrases, and templates with markup compiled to token automata.

A template is license wording with marks: ``<<beginOptional>> … <<endOptional>>`` may be left
out, ``<<var;match=".{m,n}">>`` stands for m to n words of any kind; what is outside must be
there word for word. It becomes an automaton whose states are places in the wording:
a word state goes on with its word, a wildcard state with any word, and both kinds may be
passed by where they are optional. All places where a template can begin are run side by side,
as rows of a state matrix, one word a step, until no row has a state left.

Words are those of ``words.PLAIN_LOWER``, read as hashes and mapped to the few words that
occur in templates and phrases; every text is read whole, in bounded blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pagelore.llm.tables import spare
from pagelore.llm.words import PLAIN_LOWER, starts_of, word_groups

#: Phrases and the labels they carry.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wording of public licenses and notices, with the regions that may vary.
TEMPLATES = {
    "apache-2.0": """licensed under the Apache License, Version 2.0<<beginOptional>> (the "License")<<endOptional>>""",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http://www.apache.org/licenses/LICENSE-2.0<<endOptional>>""",
    "gpl-2.0": """licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, version 2""",
    "gpl-3.0": """licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, version 3""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
        any later version.""",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
        any later version.""",
    "cc-by-4.0": """<<beginOptional>>This work is <<endOptional>>licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>Creative
        Commons Attribution 4.0 International License <<endOptional>><<beginOptional>>the <<endOptional>>CC BY 4.0""",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>the <<endOptional>>CC BY-SA 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>the <<endOptional>>CC BY-NC 4.0",
    "mit-notice": "released under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all
        copies or substantial portions of the Software. <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;match=".{1,12}">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE
        OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.<<endOptional>>""",
    "isc": """Permission to use, copy, modify, <<beginOptional>>and/or <<endOptional>><<beginOptional>>and
        <<endOptional>>distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: <<var;match=".{0,1}">> Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. <<var;match=".{0,1}">> Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or
        other materials provided with the distribution.""",
    "bsd-3-clause": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. <<var;match=".{0,1}">>
        Neither the name of <<var;match=".{1,12}">> nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
    "spdx": """SPDX-License-Identifier: <<var;match=".{1,4}">>""",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;[^>]*)>>")
_RANGE = re.compile(r'match="\.\{(\d+),(\d+)\}"')
_WORD = re.compile(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


class Step(NamedTuple):
    """A stretch of a template: words, a wildcard of ``least`` to ``most`` words, or an optional list of steps."""

    words: tuple[str, ...] = ()
    least: int = 0
    most: int = 0
    inner: tuple["Step", ...] | None = None


def words_of(text: str) -> tuple[str, ...]:
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    return tuple(_WORD.findall(text.translate(lower)))


def parse(markup: str) -> tuple[Step, ...]:
    """The steps of a template; marks that do not fit together raise ``ValueError``."""
    stack: list[list[Step]] = [[]]
    for i, part in enumerate(_MARK.split(markup)):
        if i % 2 == 0:
            words = words_of(part)
            if words:
                stack[-1].append(Step(words))
        elif part == "beginOptional":
            stack.append([])
        elif part == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            inner = tuple(stack.pop())
            stack[-1].append(Step(inner=inner))
        else:
            bounds = _RANGE.search(part)
            if not bounds or int(bounds[1]) > int(bounds[2]):
                raise ValueError(f"a replaceable region needs match=\".{{m,n}}\": {part}")
            stack[-1].append(Step(least=int(bounds[1]), most=int(bounds[2])))
    if len(stack) > 1:
        raise ValueError("beginOptional without endOptional")
    return tuple(stack[0])


def as_pattern(steps: tuple[Step, ...]) -> str:
    """The steps as a regular expression over words that each have a space before them."""
    out = ""
    for step in steps:
        if step.inner is not None:
            out += f"(?:{as_pattern(step.inner)})?"
        elif step.words:
            out += "".join(f" {re.escape(w)}" for w in step.words)
        else:
            out += f"(?: [^ ]+){{{step.least},{step.most}}}"
    return out


class Automaton:
    """The places of a template: which word each state reads (-1: any), and what is reached without reading."""

    def __init__(self, steps: tuple[Step, ...], word_id: dict[str, int]):
        self.reads: list[int] = []
        skips: list[tuple[int, int]] = []
        self._build(steps, word_id, skips)
        size = len(self.reads) + 1
        closed = np.eye(size, dtype=bool)
        for start, stop in sorted(skips, reverse=True):
            closed[start] |= closed[stop]
        for state in range(size - 1, -1, -1):          # skips lead forward only
            for to in np.flatnonzero(closed[state]):
                closed[state] |= closed[to]
        if closed[0, -1]:
            raise ValueError("a template must hold words that cannot be left out")
        self.closed, self.needed = closed, sorted(self._needed(steps, word_id))
        self.state_words = np.array(self.reads)

    def _build(self, steps, word_id, skips) -> None:
        for step in steps:
            start = len(self.reads)
            if step.inner is not None:
                self._build(step.inner, word_id, skips)
                skips.append((start, len(self.reads)))
            elif step.words:
                self.reads += [word_id[w] for w in step.words]
            else:
                self.reads += [-1] * step.most
                skips += [(start + i, start + step.most) for i in range(step.least, step.most)]

    def _needed(self, steps, word_id) -> set[int]:
        return {word_id[w] for step in steps if step.inner is None for w in step.words}

    def matches(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, stops) of the longest match from every place of ``line``, a row of word ids in which -2
        ends a text and 0 is a word of no template; the last entry is -2."""
        firsts = np.flatnonzero(self.closed[0][:-1])
        can = np.zeros(len(line), bool)
        for state in firsts:
            can |= line != -2 if self.reads[state] < 0 else line == self.reads[state]
        at = np.flatnonzero(can)
        live = np.repeat(self.closed[:1], len(at), axis=0)
        stops, rows, step = np.full(len(at), -1), np.arange(len(at)), 0
        while len(rows):
            word = line[np.minimum(at[rows] + step, len(line) - 1)]
            reads = self.state_words[None, :]
            moved = live[:, :-1] & ((reads == word[:, None]) | ((reads == -1) & (word != -2)[:, None]))
            going = moved.any(axis=1)
            rows, moved, step = rows[going], moved[going], step + 1
            live = np.zeros((len(rows), len(self.reads) + 1), bool)
            for state in np.flatnonzero(moved.any(axis=0)):
                live[moved[:, state]] |= self.closed[state + 1]
            stops[rows[live[:, -1]]] = at[rows[live[:, -1]]] + step
        good = stops >= 0
        return at[good], stops[good]


class Scanner:
    """All templates and phrases over one list of word ids (1, 2, …)."""

    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        steps = {label: parse(markup) for label, markup in templates.items()}
        words = sorted({w for s in steps.values() for w in self._all(s)} | {w for p in phrases for w in words_of(p)})
        word_id = {w: i + 1 for i, w in enumerate(words)}
        hashes = np.concatenate([h for _, _, h in word_groups(pa.array(words, pa.string()), PLAIN_LOWER)] or [np.zeros(0, np.uint64)])
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order + 1
        self.templates = {label: Automaton(s, word_id) for label, s in steps.items()}
        self.phrases = [(label, [word_id[w] for w in words_of(p)]) for p, label in phrases.items()]

    def _all(self, steps: tuple[Step, ...]) -> Iterator[str]:
        for step in steps:
            yield from step.words
            yield from self._all(step.inner or ())

    def line(self, counts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of several texts, -2 after each, and where the texts begin."""
        found = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        ids = np.where(self.hashes[found] == hashes, self.ids[found], 0)
        bounds = starts_of(counts + 1)
        line = np.full(bounds[-1], -2)
        inside = np.ones(len(line), bool)
        inside[bounds[1:] - 1] = False
        line[inside] = ids
        return line, bounds[:-1]

    def scan(self, line: np.ndarray) -> tuple[list[tuple[str, np.ndarray, np.ndarray]], list[tuple[str, np.ndarray, np.ndarray]]]:
        """Phrase places and template matches as (label, starts, stops)."""
        base, found = [], []
        present = np.zeros(len(self.ids) + 1, bool)
        present[line[line >= 0]] = True
        for label, words in self.phrases:
            if present[words].all():
                hit = np.ones(max(len(line) - len(words) + 1, 0), bool)
                for i, word in enumerate(words):
                    hit &= line[i:len(hit) + i] == word
                at = np.flatnonzero(hit)
                base.append((label, at, at + len(words)))
        for label, automaton in self.templates.items():
            if present[automaton.needed].all():
                found.append((label, *automaton.matches(line)))
        return base, found


_SPAN = T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("stop", T.LongType())]))


def _per_text(found, starts: np.ndarray) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in starts]
    for label, low, high in found:
        texts = np.searchsorted(starts, low, "right") - 1
        for i, a, b in zip(texts.tolist(), (low - starts[texts]).tolist(), (high - starts[texts]).tolist()):
            out[i].append({"label": label, "start": a, "stop": b})
    return [sorted(x, key=lambda s: (s["start"], s["label"])) for x in out]


def scan(docs: DataFrame, text: str = "text", to: str = "license_scan",
         templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` with a struct ``to``: n_words, phrases and templates, the spans of words (label, start,
    stop, from 0) where phrases stand and where templates match, the longest match from each start.

    Null and empty texts have no words and no spans; repeated rows get the same result; a column
    called ``to`` is replaced, others stay. A template that could match no words at all raises.
    """
    Scanner(templates, phrases)                  # faults in the marks are met here, not in a task
    kept = docs.drop(to) if to != text else docs
    made = spare(kept, "made")
    at = kept.columns.index(text)
    spans = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    fields = [pa.field("n_words", pa.int64()), pa.field("phrases", spans), pa.field("templates", spans)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            for first, counts, hashes in word_groups(batch.column(at), PLAIN_LOWER):
                line, starts = scanner.line(counts, hashes)
                both = [pa.array(_per_text(x, starts), spans) for x in scanner.scan(line)]
                struct = pa.StructArray.from_arrays([pa.array(counts, pa.int64()), *both], fields=fields)
                given = batch.slice(first, len(counts))
                yield pa.RecordBatch.from_arrays([*given.columns, struct], names=[*given.schema.names, made])

    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("phrases", _SPAN), T.StructField("templates", _SPAN)])
    out = kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(made, kind)]))
    return (out.drop(to) if to in kept.columns else out).withColumnRenamed(made, to)
