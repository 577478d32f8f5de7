"""License scans: phrases, and templates with optional and replaceable regions compiled into token automata.

Markup of a template: ``[[...]]`` may be left out, ``<<...>>`` stands for up to ``REPLACED`` words of any kind, every other word is mandatory and
must match exactly. An automaton starts wherever its first word stands and accepts when the last mandatory word is met.

Only A-Z are lower-cased; words are runs of ASCII letters and digits and of all characters beyond ASCII. Null and empty texts have no words and no
labels. Extra columns and repeated rows don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

REPLACED = 20

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Wording of public licenses and of the notices that name them.
TEMPLATES = {
    "mit-notice": "[[this]] [[software|project|code|work]] [[is]] released under the [[terms of the]] mit license",
    "mit-licensed": "licensed under the [[terms of the]] mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to"
        " the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in"
        " all copies or substantial portions of the software"
    ),
    "apache-notice": "licensed under the apache license [[version 2 0]]",
    "apache-header": (
        "licensed under the apache license version 2 0 the license you may not use <<this file>> except in compliance with the license you may"
        " obtain a copy of the license at [[http|https]] www apache org licenses license 2 0"
    ),
    "gpl-notice": (
        "<<this program>> is free software you can redistribute it and or modify it under the terms of the gnu [[lesser|affero]] general public license"
        " as published by the free software foundation [[either]] version <<number>> of the license [[or at your option any later version]]"
    ),
    "gpl-named": "gnu [[lesser|affero]] general public license [[version|v]] [[2|3|2 0|3 0]]",
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
        " copyright notice and this permission notice appear in all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ),
}


class Automaton:
    """Moves by state: (word, next state) pairs, free moves, and states in which any word may pass."""

    def __init__(self, template: str) -> None:
        self.moves: list[dict[str, set[int]]] = [{}]
        self.free: list[set[int]] = [set()]
        self.any: list[int | None] = [None]
        at = 0
        text = template
        while text := text.strip():
            if text.startswith("[["):
                inner, text = text[2:].split("]]", 1)
                end = self._state()
                for choice in inner.split("|"):
                    self.free[self._path(at, choice.split())].add(end)
                self.free[at].add(end)
                at = end
            elif text.startswith("<<"):
                text = text.split(">>", 1)[1]
                end = self._state()
                self.free[at].add(end)
                for _ in range(REPLACED):
                    following = self._state()
                    self.any[at] = following
                    self.free[following].add(end)
                    at = following
                at = end
            else:
                word, _, text = text.partition(" ")
                at = self._path(at, [word])
        self.last = at
        self.anchors = self._first_words()

    def _state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        self.any.append(None)
        return len(self.moves) - 1

    def _path(self, at: int, words: list[str]) -> int:
        for word in words:
            following = self._state()
            self.moves[at].setdefault(word, set()).add(following)
            at = following
        return at

    def _closed(self, states: set[int]) -> set[int]:
        """The states and what free moves reach from them."""
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return out

    def _first_words(self) -> set[str] | None:
        """The words that a match can begin with; none if it can begin with any."""
        start = self._closed({0})
        if any(self.any[s] is not None for s in start):
            return None
        return {w for s in start for w in self.moves[s]}

    def accepts(self, words: list[str], at: int) -> bool:
        """Whether a match begins at word ``at``."""
        states = self._closed({0})
        for word in words[at:]:
            following = set()
            for s in states:
                following |= self.moves[s].get(word, set())
                if self.any[s] is not None:
                    following.add(self.any[s])
            states = self._closed(following)
            if self.last in states:
                return True
            if not states:
                return False
        return False


def _mandatory(template: str) -> list[str]:
    """The longest run of mandatory words: a text without it cannot match."""
    runs, text = [], template
    for opening, closing in (("[[", "]]"), ("<<", ">>")):
        while opening in text:
            head, rest = text.split(opening, 1)
            text = head + "\n" + rest.split(closing, 1)[1]
    runs = [run.split() for run in text.split("\n")]
    return max(runs, key=len)


_SPACES = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(128)) + bytes(range(128, 256))
_SPACES = _SPACES.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    ``score`` is 0 without a label, 0.5 with base labels or short notices only, 1 where a template of ten mandatory words or more matched.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = {label: f" {phrase} ".encode() for phrase, label in PHRASES.items()}
        templates = {label: (Automaton(t), f" {' '.join(_mandatory(t))} ".encode()) for label, t in TEMPLATES.items()}
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode().translate(_SPACES).split()
                line = b" " + b" ".join(words) + b" "
                out.append((doc_id.as_py(), len(words), *_labels(words, line, phrases, templates)))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = ["bigint"] * 5 + ["string"] * 2 + ["double"]
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(rows, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _labels(words: list[bytes], line: bytes, phrases: dict, templates: dict) -> tuple:
    places, base = [], set()
    for label, phrase in phrases.items():
        at = line.find(phrase)
        while at >= 0:
            places.append(line.count(b" ", 0, at))
            base.add(label)
            at = line.find(phrase, at + 1)
    labels, long = set(base), False
    text = None
    for label, (automaton, mandatory) in templates.items():
        if mandatory not in line:
            continue
        text = text if text is not None else [w.decode() for w in words]
        for at, word in enumerate(text):
            if (automaton.anchors is None or word in automaton.anchors) and automaton.accepts(text, at):
                labels.add(label)
                long |= mandatory.count(b" ") > 10
                break
    score = 1.0 if long else 0.5 if labels else 0.0
    first, last = (min(places), max(places)) if places else (None, None)
    return len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score
