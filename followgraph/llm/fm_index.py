"""Bidirectional FM-index of a list of words, with searches of many patterns at once.

The words stand between delimiters in one text. The index holds the Burrows-Wheeler transforms of the text and of its reverse as wavelet
matrices. A pattern is a range of suffix ranks in each of them (of the same width), and can be extended by a symbol on either side.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_QUERIES = 1 << 14  # patterns extended together


class _Ranks:
    """Wavelet matrix: occurrences of a symbol, and of smaller ones, in any range of a sequence."""

    def __init__(self, symbols: np.ndarray, levels: int) -> None:
        self.symbols = symbols
        self._before, self._zeros = [], []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self._before.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self._zeros.append(len(symbols) - int(self._before[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self._start = np.zeros(1 << levels, dtype=np.int64)
        every, none = np.arange(1 << levels), np.zeros(1 << levels, dtype=np.int64)
        self._start = self.count(every, none, none)[0]

    def count(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences before ``low``, occurrences in the range, and occurrences of smaller symbols in the range."""
        smaller = np.zeros(len(symbol), dtype=np.int64)
        for k, (before, zeros) in enumerate(zip(self._before, self._zeros)):
            one = (symbol >> (len(self._before) - 1 - k)) & 1 == 1
            low_ones, high_ones = before[low], before[high]
            smaller += np.where(one, (high - high_ones) - (low - low_ones), 0)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return low - self._start[symbol], high - low, smaller


def _sorted_rotations(text: np.ndarray) -> np.ndarray:
    """Places of all rotations in order, by doubling of the compared length; no two rotations are equal."""
    n = len(text)
    rank, span = text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + 1) + np.roll(rank, -span)
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        span *= 2


class WordIndex:
    """Index of distinct, non-empty words without the code point 0."""

    def __init__(self, words: Sequence[str]) -> None:
        points = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), dtype="<u4")
        self._alphabet, text = np.unique(points, return_inverse=True)
        text = text.astype(np.int64)
        levels = max(1, int(len(self._alphabet) - 1).bit_length())
        forward = _sorted_rotations(text)
        backward = _sorted_rotations(text[::-1])
        self._size, self._words = len(text), len(words)
        self._smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << levels))])
        self._left = _Ranks(text[forward - 1], levels)
        self._right = _Ranks(text[::-1][backward - 1], levels)
        self._word_of = np.searchsorted(np.flatnonzero(text == 0), forward)

    def _codes(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, -1 for those that the index lacks, and where each word begins."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        at = np.minimum(np.searchsorted(self._alphabet, points), len(self._alphabet) - 1)
        codes = np.where(self._alphabet[at] == points, at, -1)
        return codes, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)

    def _extend(self, ranks: _Ranks, symbol: np.ndarray, own: np.ndarray, other: np.ndarray, width: np.ndarray) -> tuple:
        """Ranges after one more symbol on the side that ``ranks`` is for: rank there, rank in the other direction, width."""
        known = symbol >= 0
        before, count, less = ranks.count(np.maximum(symbol, 0), own, own + width)
        return self._smaller[np.maximum(symbol, 0)] + before, other + less, np.where(known, count, 0)

    def one_edit(self, words: Sequence[str], first_half: bool) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``words``, indexed word) for all pairs that differ by exactly one inserted, deleted or replaced code point,
        where the first half of the pattern (or the second) stands unchanged at the same end of the indexed word.

        The half is matched from the middle outwards, then the pattern is extended across the other half in the other direction. Pairs can
        come more than once.
        """
        out = [np.zeros((2, 0), dtype=np.int64)]
        for low in range(0, len(words), _QUERIES):
            some = words[low : low + _QUERIES]
            lengths = np.array([len(w) for w in some], dtype=np.int64)
            half = lengths // 2
            if not first_half:  # the mirror image
                some, half = [w[::-1] for w in some], lengths - half
            out += [found + np.array([[low], [0]]) for found in self._search(some, half, first_half)]
        pattern, word = np.concatenate(out, axis=1)
        real = word < self._words  # between the last delimiter and the first there is an empty word
        return pattern[real], word[real]

    def _search(self, words: Sequence[str], half: np.ndarray, straight: bool):
        codes, begin = self._codes(words)
        back, ahead = (self._left, self._right) if straight else (self._right, self._left)
        length = np.diff(begin)
        query = np.arange(len(words))
        own, other, width = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), self._size)
        # ``own``: rank for extension to the back, ``other``: ahead
        for step in range(int(half.max(initial=0)) + 1):
            left = half[query] - step  # at 0 comes the delimiter
            now = left >= 0
            symbol = np.where(left[now] > 0, codes[np.maximum(begin[query[now]] + left[now] - 1, 0)], 0)
            own[now], other[now], width[now] = self._extend(back, symbol, own[now], other[now], width[now])
            alive = width > 0
            query, own, other, width = query[alive], own[alive], other[alive], width[alive]
        place, errors = half[query], np.zeros(len(query), dtype=np.int64)
        while len(query):
            ended = place >= length[query]
            symbol = np.where(ended, 0, codes[np.minimum(begin[query] + place, len(codes) - 1)])
            # with the error behind, only the pattern itself can follow
            late = np.flatnonzero(errors == 1)
            new_other, new_own, new_width = self._extend(ahead, symbol[late], other[late], own[late], width[late])
            hit = new_width > 0
            over = hit & ended[late]
            if over.any():
                forward = (new_own if straight else new_other)[over]
                yield np.array([query[late][over], self._word_of[forward]])
            go = hit & ~ended[late]
            states = [(query[late][go], place[late][go] + 1, errors[late][go], new_own[go], new_other[go], new_width[go])]
            # before it, every symbol that follows in the index
            early = np.flatnonzero(errors == 0)
            state, follows = self._followers(ahead, other[early], width[early])
            at = early[state]
            new_other, new_own, new_width = self._extend(ahead, follows, other[at], own[at], width[at])
            same, inside = follows == symbol[at], ~ended[at]
            ones = np.ones(len(at), dtype=np.int64)
            everything = (query[at], place[at] + 1, 1 - same.astype(np.int64), new_own, new_other, new_width)
            states.append(tuple(x[inside] for x in everything))  # equal or replaced
            states.append((query[at], place[at], ones, new_own, new_other, new_width))  # inserted
            skip = early[~ended[early]]
            states.append((query[skip], place[skip] + 1, np.ones(len(skip), np.int64), own[skip], other[skip], width[skip]))  # deleted
            query, place, errors, own, other, width = (np.concatenate(x) for x in zip(*states))

    def _followers(self, ahead: _Ranks, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state, symbol) of the symbols but the delimiter that follow a range: read from a narrow one, all of the alphabet for a wide one."""
        size = len(self._alphabet)
        wide = np.flatnonzero(width > size)
        narrow = np.flatnonzero(width <= size)
        n = width[narrow]
        place = np.repeat(low[narrow] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        pairs = np.unique(np.repeat(narrow, n) * size + ahead.symbols[place])
        state = np.concatenate([pairs // size, np.repeat(wide, size)])
        symbol = np.concatenate([pairs % size, np.tile(np.arange(size), len(wide))])
        keep = symbol != 0
        state, symbol = state[keep], symbol[keep]
        if len(wide):
            some = ahead.count(symbol, low[state], low[state] + width[state])[1] > 0
            state, symbol = state[some], symbol[some]
        return state, symbol
