"""Byte-level BPE by forced boundaries: texts as token ids, and ids as texts.

A pair of bytes that stands inside no token of the vocabulary can never be merged, so there is a certain cut between the two. Texts are cut at such
pairs first, found for all bytes of a batch in one table look-up, and the fragments are encoded independently of each other: each distinct one
once per worker, whose ids are then put together for every text.

Two kinds of cuts come besides. The tokenizer's own: it looks for special tokens first and then for its pattern of words, numbers, marks and white space.
Its pattern can see past a forced cut only behind white space, before an apostrophe (contractions) and inside a character, so the first cuts leave those
places out; in a fragment, the pattern comes first and all forced cuts then. Merges inside a fragment run by rank from a heap, so that a
fragment's time is near its length.

A null or empty text has no ids. Rows without ``doc_id`` and repeated rows are encoded like any other. Very long texts are cut in segments, and so are
worked on in bounded memory but for their ids themselves. Extra columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from followgraph.llm.shingles import string_buffers

#: Fixed values of byte-level tokenizers: the words of a text, and their contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_SEGMENT = 2 << 20  # bytes worked on at once
_FRAGMENTS = 800_000  # kept per worker
_APOSTROPHE = 39
_SHORT = 64  # bytes up to which looking at all pairs again is faster than a heap
_ID = (1 << 32) - 1
_NEVER = 1 << 62


def _letters() -> dict[str, int]:
    """The byte that each letter of the vocabulary stands for: printable Latin-1 for itself, the rest in order from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and certain cuts of a tokenizer file of the byte-level kind."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, cut = content["model"], content["pre_tokenizer"] or {}
        plain = not model.get("byte_fallback") and not model.get("ignore_merges") and not model.get("end_of_word_suffix")
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or content["normalizer"] or not plain:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        byte = _letters()
        spelled = lambda token: bytes(byte[c] for c in token)
        self.tokens: dict[int, bytes] = {number: spelled(token) for token, number in model["vocab"].items()}
        added = content["added_tokens"]
        self.special: dict[str, int] = {a["content"]: a["id"] for a in added}
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens with rules of their own")
        self.tokens |= {number: text.encode() for text, number in self.special.items()}
        vocab = model["vocab"]
        self.single = [vocab[letter] for letter, _ in sorted(byte.items(), key=lambda x: x[1])]
        #: pairs of ids with the rank of their merge (times 2**32) and the id that they give
        self.merges: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank << 32 | vocab[left + right]
        #: pairs of bytes (the first times 256) that no token holds
        self.apart = np.ones(1 << 16, dtype=bool)
        for token in model["vocab"]:
            data = spelled(token)
            for a, b in zip(data, data[1:]):
                self.apart[a << 8 | b] = False
        #: the same, where the pattern sees no further either: before ASCII white space, or behind an ASCII character that is visible and before
        #: the first byte of one that is no apostrophe
        left, right = np.arange(1 << 16) >> 8, np.arange(1 << 16) & 255
        blank = np.isin(right, [9, 10, 11, 12, 13, 32])
        visible = (left > 32) & (left < 127) & (right != _APOSTROPHE) & ((right < 0x80) | (right >= 0xC0))
        self.safe = self.apart & (blank | visible)
        for word in CONTRACTIONS:
            data = word.encode()
            for a, b in zip(data, data[1:]):
                self.safe[a << 8 | b] = False

    def merged(self, data: bytes) -> list[int]:
        """Ids of bytes without a cut: the merge of the lowest rank comes first, of equal ones the leftmost."""
        single, merges = self.single, self.merges
        ids = [single[b] for b in data]
        if len(ids) <= _SHORT:
            best = [merges.get(pair, _NEVER) for pair in zip(ids, ids[1:])]
            while best and (least := min(best)) < _NEVER:
                at = best.index(least)
                del best[at], ids[at]
                ids[at] = least & _ID
                if at < len(best):
                    best[at] = merges.get((ids[at], ids[at + 1]), _NEVER)
                if at:
                    best[at - 1] = merges.get((ids[at - 1], ids[at]), _NEVER)
            return ids
        before, after = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        heap = [(merges[pair], at, *pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(heap)
        while heap:
            best, at, left, right = heapq.heappop(heap)
            whole = best & _ID
            end = after[at]
            if ids[at] != left or end < 0 or ids[end] != right:
                continue  # one of the two has been merged
            ids[at], ids[end] = whole, -1
            follow = after[at] = after[end]
            if follow >= 0:
                before[follow] = at
                pair = (whole, ids[follow])
                if pair in merges:
                    heapq.heappush(heap, (merges[pair], at, *pair))
            lead = before[at]
            if lead >= 0:
                pair = (ids[lead], whole)
                if pair in merges:
                    heapq.heappush(heap, (merges[pair], lead, *pair))
        return [i for i in ids if i >= 0]

    def cuts(self, data: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Places between two bytes that the table marks."""
        return np.flatnonzero(table[data[:-1].astype(np.uint16) << 8 | data[1:]]) + 1


class Codec:
    """Encodes and decodes with a vocabulary, and keeps the ids of fragments that it has met."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        self._pattern = regex.compile(PATTERN)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self._special = regex.compile(f"({'|'.join(map(regex.escape, special))})".encode()) if special else None
        numbers = np.array(sorted(self.vocabulary.tokens))
        sizes = np.zeros(int(numbers[-1]) + 1, dtype=np.int64)
        sizes[numbers] = [len(self.vocabulary.tokens[n]) for n in numbers.tolist()]
        self._token_begin = np.concatenate([[0], np.cumsum(sizes)])
        self._token_bytes = np.frombuffer(b"".join(self.vocabulary.tokens[n] for n in numbers.tolist()), dtype=np.uint8)
        self._forget()

    def _forget(self) -> None:
        self._slot: dict[bytes, int] = {}
        self._ids = np.zeros(1 << 16, dtype="<u4")
        self._begin = np.zeros(1 << 16, dtype=np.int64)
        self._used = 0

    def _learn(self, fragments: set[bytes]) -> None:
        """Ids of new fragments: their words by the pattern, each cut at all forced boundaries."""
        own = self.vocabulary
        words, counts = [], []
        for fragment in fragments:
            some = self._pattern.findall(fragment.decode("utf-8", "replace"))
            words += some
            counts.append(len(some))
        words = [word.encode() for word in words]
        borders = np.cumsum([len(word) for word in words])
        data = b"".join(words)
        cuts = np.union1d(own.cuts(np.frombuffer(data, dtype=np.uint8), own.apart), borders)
        sizes, ids, known, at = [], [], {}, 0
        for end in cuts.tolist():
            piece = data[at:end]
            found = known.get(piece)
            if found is None:
                found = known[piece] = own.merged(piece)
            ids += found
            sizes.append(len(found))
            at = end
        per_piece = np.concatenate([[0], np.cumsum(sizes)])
        words_end = np.concatenate([[0], np.searchsorted(cuts, borders, "right")])
        ends = per_piece[words_end[np.cumsum(counts)]]
        slot = len(self._slot)
        self._slot.update(zip(fragments, range(slot, slot + len(fragments))))
        while self._used + len(ids) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        while slot + len(fragments) >= len(self._begin):
            self._begin = np.concatenate([self._begin, np.zeros_like(self._begin)])
        self._ids[self._used : self._used + len(ids)] = ids
        self._begin[slot + 1 : slot + 1 + len(fragments)] = ends + self._used
        self._used += len(ids)

    def _fragments(self, data: np.ndarray) -> np.ndarray:
        """Ids of bytes without special tokens."""
        if not len(data):
            return np.zeros(0, dtype="<u4")
        if len(self._slot) >= _FRAGMENTS:
            self._forget()
        raw = data.tobytes()
        ends = [*self.vocabulary.cuts(data, self.vocabulary.safe).tolist(), len(raw)]
        fragments = [raw[a:b] for a, b in zip([0, *ends], ends)]
        if new := set(fragments).difference(self._slot):
            self._learn(new)
        slots = [*map(self._slot.__getitem__, fragments)]
        return _ranges(self._ids, self._begin, np.array(slots, dtype=np.int64))

    def encode(self, data: np.ndarray) -> np.ndarray:
        """Ids of the bytes of a text."""
        parts = [(data, None)]
        if self._special is not None and (found := list(self._special.finditer(memoryview(data)))):
            parts, at = [], 0
            for match in found:
                parts.append((data[at : match.start()], self.vocabulary.special[match[0].decode()]))
                at = match.end()
            parts.append((data[at:], None))
        out = []
        for part, special in parts:
            at = 0
            while at < len(part):
                end = min(len(part), at + _SEGMENT)
                while end < len(part):  # a segment ends at a forced boundary
                    cuts = self.vocabulary.cuts(part[at:end], self.vocabulary.safe)
                    if len(cuts):
                        end = at + int(cuts[-1])
                        break
                    end = min(len(part), end + _SEGMENT)
                out.append(self._fragments(part[at:end]))
                at = end
            if special is not None:
                out.append(np.array([special], dtype="<u4"))
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; numbers that no token has give nothing, bytes that are no UTF-8 the replacement character."""
        known = ids[ids < len(self._token_begin) - 1].astype(np.int64)
        return _ranges(self._token_bytes, self._token_begin, known).tobytes().decode("utf-8", "replace")


def _ranges(data: np.ndarray, begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``data`` of the ranges from ``begin[w]`` to ``begin[w + 1]``, one after the other."""
    sizes = begin[which + 1] - begin[which]
    ends = np.cumsum(sizes)
    return data[np.repeat(begin[which] - ends + sizes, sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """This worker's codec for a tokenizer file, given by its path or by the name under which it was added to the session."""
    if path not in _codecs:
        _codecs[path] = Codec(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _codecs[path]


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers in a binary column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            low = 0
            while low < batch.num_rows:
                ids, held = [], 0
                while low + len(ids) < batch.num_rows and held < _SEGMENT:
                    row = low + len(ids)
                    ids.append(own.encode(data[offsets[row] : offsets[row + 1]]))
                    held += int(offsets[row + 1] - offsets[row])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, len(ids)),
                        pa.array([len(i) for i in ids], pa.int64()),
                        pa.array([i.tobytes() for i in ids], pa.binary()),
                    ],
                    names=["doc_id", "n_tokens", "ids"],
                )
                low += len(ids)

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(rows, "doc_id bigint, n_tokens bigint, ids binary")


def decode(rows: DataFrame, tokenizer: str) -> DataFrame:
    """``rows`` with the column ``ids`` (binary, as from ``encode``) replaced by ``text``; a null stays null."""
    others = [c for c in rows.columns if c != "ids"]
    schema = rows.select(*others, F.lit(None).cast("string").alias("text")).schema

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            for low in range(0, batch.num_rows, 1000):
                text = [None if i is None else own.decode(np.frombuffer(i, dtype="<u4")) for i in ids.slice(low, 1000).to_pylist()]
                kept = [c.slice(low, 1000) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string())], names=schema.names)

    return rows.select(*others, "ids").mapInArrow(texts, schema)
