"""Token ids of whole texts by public tokenizers, with the ids of fragments that a worker has met before.

Texts repeat their words, and a word's ids don't depend on its neighbours where the tokenizer cuts a text anyway. The places that are certain to be cut
are found for all bytes of a batch by one look-up for each pair of neighbouring bytes; only fragments that a worker hasn't met are
encoded by the tokenizer, as texts of their own.

For byte-level BPE those are the pairs of ``boundary_bpe.Vocabulary.safe``. For BPE with word ends, which drops white space and case and looks
at runs of letters, numbers and signs one by one, they are: on either side of ASCII white space, and between a letter and a sign, either of them ASCII and the
sign no apostrophe (contractions). Special tokens of the tokenizer are fragments of their own. Fragments of Latin letters are one word for either
tokenizer, and go to its model without the search for words.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np

from followgraph.llm.boundary_bpe import Vocabulary

_MOST_FRAGMENTS = 800_000  # kept per worker and tokenizer
_AT_ONCE = 2 << 20  # bytes
_FRAGMENTS_AT_ONCE = 1 << 19

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_SIGN = np.isin(np.arange(256), [b for b in b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"])
#: second bytes of letters from U+00C0 to U+00FF, which C3 begins
_LATIN = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: letters of ASCII and from U+00C0 to U+00FF, with the space that byte-level BPE keeps
_LATIN_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _word_cuts() -> np.ndarray:
    left, right = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
    return (_WHITE[left] != _WHITE[right]) | (_LETTER[left] & _SIGN[right]) | (_SIGN[left] & _LETTER[right])


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, keeps_spaces: bool) -> Encoder:
    """This worker's encoder for the tokenizer file."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = Encoder(path, keeps_spaces)
    return _encoders[key]


class Encoder:
    def __init__(self, path: str, keeps_spaces: bool) -> None:
        """``keeps_spaces``: byte-level BPE, where a space is part of the next word's first id; else white space is dropped."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        special = sorted((t.content for t in self._tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self._special = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        self._keeps_spaces, self._letters = keeps_spaces, _byte_letters()
        self._cuts = Vocabulary(path).safe if keeps_spaces else _word_cuts()
        # a letter beyond ASCII before a sign or letter, where ASCII letters are cut from it, too
        self._after_latin = self._cuts[ord("e") << 8 | np.arange(256)] & _SIGN
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._flat = np.zeros(1 << 16, dtype=np.uint32)
        self._begin = np.zeros(1 << 16, dtype=np.int64)
        self._used = 0
        signs = [bytes([b]) for b in range(128)]
        self._learn(set(signs))
        self._sign_slots = np.array([self._slot[s] for s in signs])

    def _learn(self, fragments: set[bytes]) -> None:
        words = [f for f in fragments if _LATIN_WORD.fullmatch(f)]
        others = list(fragments.difference(words))
        plain = words if self._keeps_spaces else [w.decode().lower().encode() for w in words]
        tokenize, letters = self._tokenizer.model.tokenize, self._letters
        codes = [[t.id for t in tokenize(w.decode("latin-1").translate(letters))] for w in plain]
        if others:
            texts = [f.decode("utf-8", "replace") for f in others]
            codes += [code.ids for code in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        fragments = words + others
        ids = [i for code in codes for i in code]
        ends = np.cumsum([len(code) for code in codes])
        slot, end = len(self._slot), len(self._slot) + len(fragments)
        while self._used + len(ids) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros_like(self._flat)])
        while end >= len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
        self._slot.update(zip(fragments, range(slot, end)))
        self._flat[self._used : self._used + len(ids)] = ids
        self._begin[slot + 1 : end + 1] = ends + self._used
        self._used += len(ids)

    def _places(self, data: np.ndarray, raw: bytes, borders: np.ndarray) -> np.ndarray:
        """Places between bytes where a text begins or ends, or the tokenizer is certain to cut."""
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = self._cuts[data[:-1].astype(np.uint16) << 8 | data[1:]]
        latin = np.flatnonzero(data[:-2] == 0xC3) + 2
        cut[latin] |= _LATIN[data[latin - 1]] & self._after_latin[data[latin]]
        if self._special is not None:
            for match in self._special.finditer(raw):
                if np.searchsorted(borders, match.start(), "right") != np.searchsorted(borders, match.end()):
                    continue  # half of it ends one text, the other half begins the next
                cut[match.start() + 1 : match.end()] = False
                cut[list(match.span())] = True
        cut[borders] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and their number per text; text k is ``data[offsets[k] : offsets[k + 1]]``."""
        if len(self._slot) > _MOST_FRAGMENTS:
            self._forget()
        begin, borders = int(offsets[0]), offsets - int(offsets[0])
        data = data[begin : int(offsets[-1])]
        if not len(data):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets) - 1, dtype=np.int64)
        raw = data.tobytes()
        if not self._keeps_spaces:
            lower = raw.lower()  # of A-Z
            if self._special is None or len(self._special.findall(lower)) == len(self._special.findall(raw)):
                data, raw = _LOWER[data], lower
        cuts = self._places(data, raw, borders)
        ends = cuts[1:]
        cuts = cuts[:-1]
        if not self._keeps_spaces:
            some = ~_WHITE[data[cuts]]
            cuts, ends = cuts[some], ends[some]
        slots = np.empty(len(cuts), dtype=np.int64)
        signs = ends - cuts == 1
        slots[signs] = self._sign_slots[data[cuts[signs]]]
        longer = np.flatnonzero(~signs)
        for low in range(0, len(longer), _FRAGMENTS_AT_ONCE):
            some = longer[low : low + _FRAGMENTS_AT_ONCE]
            fragments = [raw[a:b] for a, b in zip(cuts[some].tolist(), ends[some].tolist())]
            found = np.fromiter(map(self._slot.get, fragments, repeat(-1)), dtype=np.int64, count=len(fragments))
            new = np.flatnonzero(found < 0).tolist()
            if new:
                self._learn({fragments[k] for k in new})
                found[new] = [self._slot[fragments[k]] for k in new]
            slots[some] = found
        sizes = self._begin[slots + 1] - self._begin[slots]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self._flat[np.repeat(self._begin[slots] - total[:-1], sizes) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(cuts, borders)])


def groups(offsets: np.ndarray, limit: int = _AT_ONCE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit)))
        high = min(high, len(offsets) - 1)
        yield low, high
        low = high
