"""Best products of two vector tables, from blocks of rows that columns stream past.

Every row vector goes to one block, by hash of the id; a block is one task. Every column vector goes to all blocks, in packs of a few KB, and
passes by in the order of the ids. A task holds its rows with their ``n`` best columns so far, whose lowest score settles nearly all
further ones by one comparison: only better ones are rounded, compared and put in their place. So no task sees a whole table, no answer but a row's best leaves a
task, and the shuffles carry the rows once, the columns once a block, and rows x n answers. Blocks are as large as the memory for their answers allows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from followgraph.functions.vectors import has_cosine, is_complete

BLOCK_ROWS = 100_000
BLOCK_COLUMNS = 8_192  # columns that a task compares at once
MAX_PARTITIONS = 50_000
_SMALL_BLOCK = 2_500  # rows below which a block isn't made smaller to occupy more tasks
_ANSWERS = 4_000_000  # best columns so far that a task holds
_SCORE_CELLS = 524_288  # scores held at once inside a task
_DENSE_SHARE = 16  # more than 1/16 of the scores being candidates, they are cut row by row
_DIGITS = 12  # equal vectors get equal scores whatever the order of the sums
_PACK_BYTES = 16 << 10
_ROWS_PER_MESSAGE = 100_000
_NOBODY = np.iinfo(np.int64).max
PACK = "block int, part int, first bigint, ids binary, vectors binary"
FOUND = "row_id bigint, column_id bigint, score double, rank int"
NEEDS = "part int, needed binary"
_SLACK = 1e-9  # of a cosine, for rounding


@dataclass(frozen=True)
class Shapes:
    """Centre (of length 1), largest angle to it and largest norm of each part of the columns."""

    centres: np.ndarray
    angle: np.ndarray
    norm: np.ndarray


def _scaled(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled to length 1 (zero vectors stay), and their lengths."""
    matrix = matrix.astype(np.float64)
    # Scaling by the largest element first keeps very small and very large factors in range.
    largest = np.abs(matrix).max(axis=1, keepdims=True)
    matrix = matrix / np.where(largest == 0, 1, largest)
    length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1, length), (largest * length)[:, 0]


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return _scaled(flat.reshape(len(vectors), -1))


def _best_per_row(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the n highest finite scores per row; of equal scores the first columns."""
    if scores.shape[1] > n:
        bound = np.partition(scores, scores.shape[1] - n, axis=1)[:, scores.shape[1] - n, None]
        better = scores > bound
        equal = scores == bound
        room = n - better.sum(axis=1, keepdims=True)
        keep = better | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))
    else:
        keep = np.ones(scores.shape, dtype=bool)
    return np.nonzero(keep & (scores > -np.inf))


class _Block:
    """The rows of a block with their best columns so far."""

    def __init__(
        self, parts, ids, vectors, n: int, unit: bool, skip_same_id: bool, in_order: bool, allowed: np.ndarray | None, shapes: Shapes | None
    ) -> None:
        self.n, self.unit, self.skip, self.in_order, self.allowed, self.shapes = n, unit, skip_same_id, in_order, allowed, shapes
        self.ids = ids
        self.rows, self.lengths = _scaled(vectors)
        self.scores = np.full((len(ids), n), -np.inf)
        self.partners = np.full((len(ids), n), _NOBODY)
        self._heard: list[tuple[np.ndarray, np.ndarray]] = []
        self._known: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None
        starts = np.flatnonzero(np.diff(parts, prepend=parts[0] - 1))
        self.runs = [(int(parts[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(parts)])]

    def leave_out(self, row_ids: np.ndarray, column_ids: np.ndarray) -> None:
        """Pairs that are no answers; all of them come before the first column."""
        order = np.argsort(self.ids, kind="stable")
        ids = self.ids[order]
        low, high = np.searchsorted(ids, row_ids, "left"), np.searchsorted(ids, row_ids, "right")
        times = high - low  # rows with this id
        place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        self._heard.append((order[np.repeat(low, times) + place].astype(np.int32), np.repeat(column_ids, times)))

    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows and columns of the pairs that are left out, in order; their distinct columns; the pairs as numbers, ascending."""
        if self._known is None:
            rows, columns = (np.concatenate(x) for x in zip(*self._heard))
            order = np.lexsort((columns, rows))
            rows, columns = rows[order], columns[order]
            distinct, place = np.unique(columns, return_inverse=True)
            self._known, self._heard = (rows, columns, distinct, rows.astype(np.int64) * len(distinct) + place), self._heard[:1]
        return self._known

    def _are_left_out(self, rows: np.ndarray, column_ids: np.ndarray) -> np.ndarray:
        _, _, distinct, codes = self._pairs()
        if not len(codes):
            return np.zeros(len(rows), dtype=bool)
        at = np.minimum(np.searchsorted(distinct, column_ids), len(distinct) - 1)
        code = rows.astype(np.int64) * len(distinct) + at
        found = codes[np.minimum(np.searchsorted(codes, code), len(codes) - 1)] == code
        return found & (distinct[at] == column_ids)

    def _blank(self, scores: np.ndarray, at: np.ndarray, ids: np.ndarray) -> None:
        """No score for the pairs that are left out; the ids are in ascending order."""
        rows, columns, _, _ = self._pairs()
        some = slice(*np.searchsorted(rows, [at[0], at[-1] + 1]))
        rows, columns = rows[some], columns[some]
        place = np.searchsorted(at, rows)
        here = at[place] == rows
        rows, columns = place[here], columns[here]
        first, end = np.searchsorted(ids, columns, "left"), np.searchsorted(ids, columns, "right")
        while (there := first < end).any():
            scores[rows[there], first[there]] = -np.inf
            first = first + 1

    def add(self, part: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Columns of one part; ``in_order`` promises that later ones have no smaller ids."""
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        columns, lengths = _scaled(vectors[order])
        weighted = columns if self.unit else columns * lengths[:, None]
        step = max(1, _SCORE_CELLS // len(ids))
        for row_part, low, high in self.runs:
            if self.allowed is not None and not self.allowed[row_part, part]:
                continue
            chosen = np.arange(low, high)
            if self.shapes is not None:
                chosen = chosen[self._can_gain(slice(low, high), slice(part, part + 1))[:, 0]]
            for start in range(0, len(chosen), step):
                self._compare(chosen[start : start + step], ids, columns, lengths, weighted)

    def _can_gain(self, at: slice, parts: slice) -> np.ndarray:
        """Whether the highest possible score of each row with each part of the columns reaches the row's lowest."""
        shape, lowest = self.shapes, self.scores[at, -1]
        near, radius, norm = shape.centres[parts], shape.angle[parts], shape.norm[parts]
        cosine = np.clip(self.rows[at] @ near.T, -1, 1)
        highest = cosine * np.cos(radius) + np.sqrt(1 - cosine * cosine) * np.sin(radius)
        highest[cosine >= np.cos(radius)] = 1
        if self.unit:
            return highest + _SLACK >= lowest[:, None]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            bound = lowest / self.lengths[at]  # a zero row takes any column
            return ~((np.maximum(highest, 0) + _SLACK) * norm < (bound - _SLACK * np.abs(bound))[:, None])

    def needs(self) -> Iterator[pa.RecordBatch]:
        """The parts of the columns that can hold a better answer of any row of a part of the rows, as bits."""
        parts, needed = [], []
        step = max(1, _SCORE_CELLS // len(self.shapes.norm))
        for part, low, high in self.runs:
            some = np.zeros(len(self.shapes.norm), dtype=bool)
            for start in range(low, high, step):
                some |= self._can_gain(slice(start, min(start + step, high)), slice(None)).any(axis=0)
            parts.append(part)
            needed.append(np.packbits(some).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(needed, pa.binary())], names=["part", "needed"])

    def _candidates(self, at: np.ndarray, lengths: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        """Whether a score can be among the best: all that are, and hardly any others."""
        lowest, found = self.scores[at, -1], self.rows[at] @ weighted.T
        half = 0.5 * 10.0**-_DIGITS
        if self.unit:
            # with the columns in order an equal score comes too late
            return found > (lowest + 0.98 * half if self.in_order else lowest - 1.02 * half)[:, None]
        with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
            bound = lowest / self.lengths[at]
            bound -= 1e-14 * np.abs(np.where(np.isfinite(bound), bound, 0)) + 1.02 * half * lengths.max() + np.finfo(float).tiny
        # a zero row takes the first columns
        bound = np.where(np.isnan(bound), np.inf if self.in_order else -np.inf, bound)
        return found >= bound[:, None]

    def _exact(self, rows: np.ndarray, row_lengths: np.ndarray, columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        scores = np.round(np.einsum("ij,ij->i", rows, columns), _DIGITS)
        return scores if self.unit else scores * (row_lengths * lengths)  # products of any size keep their digits

    def _compare(self, at: np.ndarray, ids: np.ndarray, columns: np.ndarray, lengths: np.ndarray, weighted: np.ndarray) -> None:
        ordinary = self.unit or (np.isfinite(lengths).all() and np.isfinite(self.lengths[at]).all() and lengths.max() < 1e150)
        mask = self._candidates(at, lengths, weighted) if ordinary else None
        number = mask.size if mask is None else np.count_nonzero(mask)
        if not number:
            return
        own = self.ids[at]
        if mask is None or number * _DENSE_SHARE > mask.size:
            scores = np.round(self.rows[at] @ columns.T, _DIGITS)
            if not self.unit:
                scores *= self.lengths[at, None] * lengths[None, :]
            if self.skip:
                scores[own[:, None] == ids[None, :]] = -np.inf
            if self._heard:
                self._blank(scores, at, ids)
            r, c = _best_per_row(scores, self.n)
            s = scores[r, c]
        else:
            r, c = np.divmod(np.flatnonzero(mask), mask.shape[1])
            s = self._exact(self.rows[at][r], self.lengths[at][r], columns[c], lengths[c])
        lowest = self.scores[at, -1][r]
        keep = s > lowest if self.in_order else s >= lowest
        if self.skip:
            keep &= own[r] != ids[c]
        r, c, s = r[keep], c[keep], s[keep]
        if self._heard and len(r):
            keep = ~self._are_left_out(at[r], ids[c])
            r, c, s = r[keep], c[keep], s[keep]
        if len(r):
            self._place(at[r], ids[c], s)

    def _place(self, rows: np.ndarray, partners: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((partners, -scores, rows))
        rows, partners, scores = rows[order], partners[order], scores[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        sizes = np.diff(starts, append=len(rows))
        place, line = np.arange(len(rows)) - np.repeat(starts, sizes), np.repeat(np.arange(len(starts)), sizes)
        kept = place < self.n
        changed = rows[starts]
        width = self.n + min(self.n, int(sizes.max()))
        both = np.full((len(changed), width), -np.inf), np.full((len(changed), width), _NOBODY)
        for side, old, new in zip(both, (self.scores, self.partners), (scores, partners)):
            side[:, : self.n] = old[changed]
            side[line[kept], self.n + place[kept]] = new[kept]
        best = np.lexsort((both[1], -both[0]))[:, : self.n]
        self.scores[changed] = np.take_along_axis(both[0], best, axis=1)
        self.partners[changed] = np.take_along_axis(both[1], best, axis=1)

    def found(self) -> Iterator[pa.RecordBatch]:
        """The best of each id, ranked; rows with the same id are one."""
        _, first, copies = np.unique(self.ids, return_inverse=True, return_counts=True)
        copied = (copies > 1)[first]
        step = max(1, _ROWS_PER_MESSAGE // self.n)
        for rows in np.split(np.flatnonzero(~copied), range(step, len(self.ids), step)):
            scores = self.scores[rows]
            r, c = np.nonzero(scores > -np.inf)
            yield self._answers(rows[r], c, c + 1)
        rows = np.flatnonzero(copied)
        r, c = np.nonzero(self.scores[rows] > -np.inf)
        r = rows[r]
        order = np.lexsort((self.partners[r, c], -self.scores[r, c], self.ids[r]))
        r, c = r[order], c[order]
        starts = np.flatnonzero(np.diff(first[r], prepend=-1))
        rank = np.arange(len(r)) - np.repeat(starts, np.diff(starts, append=len(r))) + 1
        kept = rank <= self.n
        yield self._answers(r[kept], c[kept], rank[kept])

    def _answers(self, r: np.ndarray, c: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
        parts = [self.ids[r], self.partners[r, c], self.scores[r, c], rank.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["row_id", "column_id", "score", "rank"])


def _unpacked(packs: list[tuple[int, bytes, bytes]], dtype: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.concatenate([np.frombuffer(p[1], "<i8") for p in packs])
    parts = np.repeat([p[0] for p in packs], [len(p[1]) // 8 for p in packs])
    return parts, ids, np.frombuffer(b"".join(p[2] for p in packs), dtype).reshape(len(ids), -1)


def _stream_function(
    n: int, unit: bool, skip_same_id: bool, types: tuple[str, str], in_order: bool, at_once: int, allowed: np.ndarray | None,
    shapes: Shapes | None, only_needs: bool,
):
    def best_of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, waiting, number = None, None, [], 0

        def compare() -> None:
            nonlocal block, waiting, number
            if waiting and current[1] == -2:
                block = _Block(*_unpacked(waiting, types[0]), n, unit, skip_same_id, in_order, allowed, shapes)
            elif waiting and block is not None and current[1] == -1:
                _, ids, partners = _unpacked(waiting, "<i8")
                block.leave_out(ids, partners[:, 0])
            elif waiting and block is not None:
                _, ids, vectors = _unpacked(waiting, types[1])
                block.add(current[1], ids, vectors)
            waiting, number = [], 0

        for batch in batches:
            blocks, sides, parts = (batch.column(k).to_pylist() for k in range(3))
            for k, (at, side, part) in enumerate(zip(blocks, sides, parts)):
                now = (at, side - 2 if side < 2 else part)  # the rows of all parts, what is left out, then the columns part by part
                if now != current or (side and number >= at_once):
                    compare()
                    if block is not None and current[0] != at:
                        yield from block.needs() if only_needs else block.found()
                        block = None
                    current = now
                ids = batch.column(3)[k].as_py()
                waiting.append((part, ids, batch.column(4)[k].as_py()))
                number += len(ids) // 8
        compare()
        if block is not None:
            yield from block.needs() if only_needs else block.found()

    return best_of_blocks


def element_type(side: DataFrame, vector: str) -> str:
    """Factors of single precision travel as such."""
    return "<f4" if isinstance(side.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def packed(side: DataFrame, dtype: str) -> DataFrame:
    """Packs of (id, vector, block, part), each of one block and one part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, block, part = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3))
            matrix = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(ids), -1)
            order = np.lexsort((part, block))
            changes = (np.diff(block[order]) != 0) | (np.diff(part[order]) != 0)
            step = max(1, _PACK_BYTES // (matrix.itemsize * matrix.shape[1]))
            rows = []
            for run in np.split(order, np.flatnonzero(changes) + 1):
                for start in range(0, len(run), step):
                    own = run[start : start + step]
                    rows.append((block[own[0]], part[own[0]], ids[own[0]], ids[own].astype("<i8").tobytes(), matrix[own].tobytes()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "part", "first", "ids", "vectors"])

    return side.mapInArrow(pack, PACK)


def streamed_products(
    rows: DataFrame, columns: DataFrame, blocks: int, n: int, unit: bool, skip_same_id: bool, types: tuple[str, str],
    in_order: bool = True, at_once: int = BLOCK_COLUMNS, allowed: np.ndarray | None = None, left_out: DataFrame | None = None,
    shapes: Shapes | None = None, only_needs: bool = False,
) -> DataFrame:
    """(row_id, column_id, score, rank): the best ``n`` of each row among the columns that come to its block.

    Both sides are packs; those of the columns name the block that they go to, and with ``side`` (2 or 3) which of them come first. ``allowed`` says which part of the
    columns each part of the rows is compared with, ``left_out`` are packs of pairs that are no answers. The rank is that among the rows of one id in one block.
    With ``shapes`` of the parts of the columns a row is compared with those only that can hold a better answer; ``only_needs`` returns
    (part, needed) instead, the parts that the rows of each part need after what has come.
    """
    if "side" not in columns.columns:
        columns = columns.withColumn("side", F.lit(2))
    both = rows.withColumn("side", F.lit(0)).unionByName(columns)
    if left_out is not None:
        both = both.unionByName(left_out.withColumn("side", F.lit(1)))
    ordered = (
        both.select("block", "side", "part", "ids", "vectors", "first")
        .repartitionById(blocks, F.col("block"))
        .sortWithinPartitions("block", "side", "part", "first")
    )
    function = _stream_function(n, unit, skip_same_id, types, in_order, at_once, allowed, shapes, only_needs)
    return ordered.mapInArrow(function, NEEDS if only_needs else FOUND)


def rows_per_block(rows: int, n: int, parallelism: int, most: int = BLOCK_ROWS) -> int:
    """As many as there is memory for their answers, but small enough to occupy the cores twice."""
    return max(1, min(most, max(1, _ANSWERS // n), max(_SMALL_BLOCK, math.ceil(rows / (2 * parallelism)))))


def usable(side: DataFrame, name: str, id_column: str, vector: str, unit: bool) -> DataFrame:
    """(name_id, name_vector) of the vectors that take part."""
    takes_part = has_cosine(F.col(vector)) if unit else is_complete(F.col(vector))
    kind = "array<float>" if element_type(side, vector) == "<f4" else "array<double>"
    return side.where(takes_part).select(
        F.col(id_column).cast("bigint").alias(f"{name}_id"), F.col(vector).cast(kind).alias(f"{name}_vector")
    )


def ranked(found: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("row_id").orderBy(F.desc("score"), "column_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n)
        .select("row_id", "rank", "column_id", "score")
    )


def pairs_left_out(left_out: DataFrame) -> DataFrame:
    """(row_id, columns) with one column each, as packs need them."""
    pairs = left_out.select(F.col("row_id").cast("bigint").alias("row_id"), F.array(F.col("column_id").cast("bigint")).alias("columns"))
    return pairs.where("row_id is not null and columns[0] is not null")


def best_products(
    rows: DataFrame,
    columns: DataFrame,
    n: int,
    id_column: str = "id",
    vector: str = "features",
    unit: bool = False,
    skip_same_id: bool = False,
    block_rows: int = BLOCK_ROWS,
    block_columns: int = BLOCK_COLUMNS,
    left_out: DataFrame | None = None,
) -> DataFrame:
    """(row_id, rank, column_id, score): the ``n`` columns with the highest product for each row.

    ``unit`` scales vectors to length 1 first, which makes the score the cosine. Equal scores (12
    decimals of the cosine) are ordered by id. Incomplete vectors take no part, and with ``unit`` neither do zero
    vectors. Both inputs have integer ids and are read twice, so they should be stored tables. ``left_out`` (row_id, column_id) are pairs that are no answers:
    they go to the block of their row, so that nobody needs a longer list for them. A row's answers are whole in its block and ranked there.
    """
    types = element_type(rows, vector), element_type(columns, vector)
    left, right = usable(rows, "row", id_column, vector, unit), usable(columns, "column", id_column, vector, unit)
    total = left.count()
    blocks = max(1, math.ceil(total / rows_per_block(total, n, rows.sparkSession.sparkContext.defaultParallelism, block_rows)))
    block = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    row_packs = packed(left.select("row_id", "row_vector", block.alias("block"), F.lit(0).alias("part")), types[0])
    # in the order of the ids, which the packs of a block are put back into
    in_order = right.orderBy("column_id").select("column_id", "column_vector", F.lit(0).alias("block"), F.lit(0).alias("part"))
    column_packs = packed(in_order, types[1]).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if left_out is not None:
        pairs = pairs_left_out(left_out)
        left_out = packed(pairs.select("row_id", "columns", block.alias("block"), F.lit(0).alias("part")), "<i8")
    found = streamed_products(row_packs, column_packs, blocks, n, unit, skip_same_id, types, at_once=block_columns, left_out=left_out)
    return found.select("row_id", "rank", "column_id", "score")
