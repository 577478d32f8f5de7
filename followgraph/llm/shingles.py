"""Word shingles of whole texts as 64-bit hashes, vectorised over the bytes of an Arrow string column.

Words are runs of bytes other than space and ``\\t \\n \\v \\f \\r``; only A-Z are lower-cased. A shingle
is the hash of ``width`` consecutive word hashes; a text with fewer words has its whole word sequence as its only
shingle. Two different shingles of one text get the same hash with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_PIECE = 1 << 20  # bytes hashed at once; longer texts are cut between words
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the base, kept between calls."""
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS)), _BASE, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown)
    return _POWERS


def _piece_words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start byte of each word of ``data``; a word also ends where a text begins."""
    data = _LOWER[data]
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at_begin = begins[begins < len(data)]
    first[at_begin] = word[at_begin]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts
    # the bytes of word k, summed with falling powers of their place in the word
    owner = np.cumsum(first) - 1
    inside = np.flatnonzero(word)
    owner = owner[inside]
    place = inside - starts[owner]
    terms = _BYTE[data[inside]] * _powers(int(place.max()) + 1)[place]
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    sums = np.add.reduceat(terms, edges)
    return mixed(sums + np.diff(np.append(edges, len(owner))).astype(np.uint64)), starts


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, per text the index of its first word (one more at the end), and each word's first byte."""
    hashes, starts = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(end, at + _PIECE)
        while stop < end:  # move the cut to a place between words
            window = _SPACE[data[at:stop]]
            spaces = np.flatnonzero(window)
            begun = offsets[np.searchsorted(offsets, at, "right") : np.searchsorted(offsets, stop, "right")]
            cut = max(int(spaces[-1]) + at + 1 if len(spaces) else at, int(begun[-1]) if len(begun) else at)
            if cut > at:
                stop = cut
                break
            stop = min(end, stop + _PIECE)
        begins = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        h, s = _piece_words(data[at:stop], begins)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.int64)
    places = np.concatenate(starts)
    return np.concatenate(hashes), np.searchsorted(places, offsets), places


def gram_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order (repeats included) and, per text, the index of its first one."""
    counts = np.diff(firsts)
    rolled = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _powers(width + 1)[k + 1]
    rolled = mixed(rolled + np.uint64(width))
    long = counts >= width
    sizes = np.where(long, counts - width + 1, (counts > 0).astype(np.int64))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(int(edges[-1]), dtype=np.uint64)
    keep = np.repeat(firsts[:-1][long] - np.concatenate([[0], np.cumsum(sizes[long])])[:-1], sizes[long])
    slots = np.repeat(long, sizes)
    out[slots] = rolled[keep + np.arange(len(keep))]
    for t in np.flatnonzero((counts > 0) & ~long):
        own = words[firsts[t] : firsts[t + 1]]
        total = np.sum(own * _powers(width + 1)[1 : len(own) + 1], dtype=np.uint64)
        out[edges[t]] = mixed(np.array([total + np.uint64(len(own))], dtype=np.uint64))[0]
    return out, edges


def text_chunks(texts: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each; a longer text is a range of its own."""
    offsets = string_buffers(texts)[1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1)
        yield low, high
        low = high


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    kind = np.int64 if wide else np.int32
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
    return data, offsets


def gram_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text."""
    data, offsets = string_buffers(texts)
    for low, high in text_chunks(texts):
        words, firsts, _ = word_hashes(data, offsets[low : high + 1])
        grams, edges = gram_hashes(words, firsts, width)
        for row in range(high - low):
            yield low + row, np.unique(grams[edges[row] : edges[row + 1]])
