"""Exact top-k by inner product over a bit-sliced index.

Each component x of a vector becomes the integer floor(256 * x). Blocks of rows hold these integers as slices: one bitmap per component and
bit, over the rows of the block; a block is the work of one task, past which the queries stream. A query's scores are sums of slices, shifted by the bits of the query's own components: a carry-save adder
reduces all bitmaps of one weight to one, which is a slice of the scores. The top rows are then selected from the most significant
slice downward. Rows that are still tied at the end are the boundary; they are settled by exact scores and the smaller id.

Vectors that are null or hold null or non-finite components take no part. Missing components of shorter vectors count as 0. Rows with the same
id and vector count once; of several vectors with one id the greatest score counts as candidate, and each asks as query. Empty tables give
no rows. Components must be below 2**31 / 256, so that a score fits in 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from followgraph.operators import tiles
from followgraph.session import written

SCALE = 256
BLOCK_ROWS = 16_384  # at least, where there are more
MOST_ROWS = 32_768
_CELLS = 1 << 22  # integers of a block
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v): the integer vectors of the usable rows."""
    x = F.col(vector_column)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = F.transform(x, lambda e: F.floor(SCALE * e.cast("double")).cast("bigint"))
    rows = vectors.where(x.isNotNull() & ~bad & F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("bigint").alias("id"), whole.alias("v")).distinct()


class _Index:
    """The slices of one block of rows."""

    def __init__(self, ids: np.ndarray, integers: np.ndarray) -> None:
        self.ids, self.integers = ids, integers
        width = integers.shape[1]
        low = integers.min(axis=0)
        self.bits = np.array([int(m).bit_length() for m in (integers.max(axis=0) - low).astype(np.uint64)], dtype=np.int64)
        words = -(-len(ids) // 64)
        self.slices = np.zeros((int(self.bits.sum()), words), dtype="<u8")
        padded, at = np.zeros(64 * words, dtype=np.uint64), 0
        for d in range(width):
            padded[: len(ids)] = (integers[:, d] - low[d]).astype(np.uint64)
            for b in range(int(self.bits[d])):
                self.slices[at] = np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
                at += 1
        self.most = int(np.unique(ids, return_counts=True)[1].max(initial=1))  # vectors of one id
        self.everyone = np.zeros(64 * words, dtype=np.uint8)
        self.everyone[: len(ids)] = 1

    def search(self, query_ids: np.ndarray, vectors: np.ndarray, k: int) -> pa.RecordBatch:
        """The best ``k`` rows of the block for each query."""
        out: list[tuple[np.ndarray, ...]] = []
        for query_id, query in zip(query_ids, vectors):
            others = self.everyone.copy()
            others[np.flatnonzero(self.ids == query_id)] = 0
            valid = np.packbits(others, bitorder="little").view("<u8")
            chosen = select_top(score_slices(query, self.bits, self.slices), valid, k * self.most)
            at = np.flatnonzero(np.unpackbits(chosen.view(np.uint8), bitorder="little"))
            scores = self.integers[at] @ query  # exact, for the chosen rows and the boundary only
            best = np.lexsort((self.ids[at], -scores))
            # rows with one id and several vectors: the best one of each id
            _, first = np.unique(self.ids[at][best], return_index=True)
            best = best[np.sort(first)][:k]
            out.append((np.full(len(best), query_id), self.ids[at][best], scores[best]))
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, dtype=np.int64)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])


def _digits(value: int) -> list[tuple[int, int]]:
    """(sign, shift) of a number's signed binary digits, no two of them beside each other."""
    sign, value, shift, out = (1 if value >= 0 else -1), abs(value), 0, []
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((sign * digit, shift))
            value -= digit
        value >>= 1
        shift += 1
    return out


def score_slices(query: np.ndarray, bits: np.ndarray, slices: np.ndarray) -> list[np.ndarray]:
    """Slices, lowest first, of a number that is the inner product up to a constant of the block.

    ``-1`` times a number of n bits is its complement less 2**n - 1, so that only sums of bitmaps occur.
    """
    first = np.cumsum(bits) - bits
    plain: dict[int, list[int]] = {}
    turned: dict[int, list[int]] = {}
    for d in np.flatnonzero(query):
        for sign, shift in _digits(int(query[d])):
            target = plain if sign > 0 else turned
            for b in range(int(bits[d])):
                target.setdefault(shift + b, []).append(int(first[d]) + b)
    out, carried, weight = [], None, 0
    last = max([*plain, *turned], default=-1)
    while weight <= last or carried is not None:
        parts = [] if carried is None else [carried]
        if weight in plain:
            parts.append(slices[plain[weight]])
        if weight in turned:
            parts.append(slices[turned[weight]] ^ _ONES)
        stack = np.concatenate(parts) if parts else np.zeros((0, slices.shape[1]), dtype=np.uint64)
        carries = []
        while len(stack) > 1:
            if len(stack) == 2:
                carries.append((stack[0] & stack[1])[None])
                stack = (stack[0] ^ stack[1])[None]
            else:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                half = a ^ b
                carries.append((a & b) | (c & half))
                stack = np.concatenate([half ^ c, stack[3 * third :]])
        out.append(stack[0] if len(stack) else np.zeros(slices.shape[1], dtype=np.uint64))
        carried = np.concatenate(carries) if carries else None
        weight += 1
    return out


def select_top(slices: list[np.ndarray], valid: np.ndarray, k: int) -> np.ndarray:
    """Bitmap of the rows with the ``k`` greatest numbers, and of all that tie with the last of them."""
    sure, open_ = np.zeros_like(valid), valid.copy()
    for bitmap in reversed(slices):
        ahead = open_ & bitmap
        n = int(np.bitwise_count(sure).sum() + np.bitwise_count(ahead).sum())
        if n >= k:
            open_ = ahead
        else:
            sure |= ahead
            open_ &= ~bitmap
    return sure | open_


def rows_per_block(count: int, width: int, parallelism: int) -> int:
    """Enough to make the most of a slice, few enough to occupy the cores twice; wide vectors make smaller blocks."""
    rows = min(MOST_ROWS, max(BLOCK_ROWS, -(-count // (2 * parallelism))))
    return max(64, min(rows, _CELLS // width))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows for every row in ``queries``, itself left out.

    A block is one task, which makes the block's index and holds it while packs of all queries pass by; the shuffle carries the rows once and
    the queries once a block.
    """
    rows = written(quantised(vectors, id_column, vector_column), "integers")
    count, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    width = max(1, width)
    blocks = max(1, -(-count // rows_per_block(count, width, rows.sparkSession.sparkContext.defaultParallelism)))
    whole = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v"))).alias("v")
    block = F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block")
    own = tiles.packed(rows.select("id", whole, block, F.lit(0).alias("part")), "<i8")
    asked = tiles.packed(rows.where(queries).select("id", whole, F.lit(0).alias("block"), F.lit(1).alias("part")), "<i8")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    passing = own.unionByName(asked).select("block", "part", "ids", "vectors").repartitionById(blocks, F.col("block"))
    found = passing.sortWithinPartitions("block", "part").mapInArrow(_search_function(k), "query_id bigint, vec_id bigint, score bigint")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(ids: list[bytes], vectors: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.frombuffer(b"".join(ids), "<i8")
    return flat, np.frombuffer(b"".join(vectors), "<i8").reshape(len(flat), -1)


def _search_function(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, index, ids, vectors = None, None, [], []
        for batch in batches:
            blocks, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for row, (block, part) in enumerate(zip(blocks, parts)):
                if block != current:
                    current, index, ids, vectors = block, None, [], []
                own = batch.column(2)[row].as_py(), batch.column(3)[row].as_py()
                if part == 0:  # the rows of a block come before the queries
                    ids.append(own[0])
                    vectors.append(own[1])
                    continue
                if index is None and ids:
                    index, ids, vectors = _Index(*_unpacked(ids, vectors)), [], []
                if index is not None:
                    yield index.search(*_unpacked([own[0]], [own[1]]), k)

    return search
