"""Tokenised documents as a written table, with each document's place among all ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from followgraph.llm.common import small_side
from followgraph.llm.shingles import string_buffers
from followgraph.llm.tokens import encoder, groups
from followgraph.session import written

_BLOCK = 4 << 20  # bytes of text that a block of the table holds at least, unless its partition ends


def token_table(docs: DataFrame, tokenizer: str, keeps_spaces: bool, end_id: int) -> DataFrame:
    """(part, block, before_block, doc_ids, sizes, ids): blocks of documents in the order of the partitions of ``docs``.

    ``ids`` holds little-endian unsigned 32-bit ids, of 16 bits where the vocabulary allows. ``before_block`` counts the ids of the
    partition before the block. A null text is empty; ``end_id`` follows every document. The table is written, so that what
    is counted and what is cut later are the same rows.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        encode = encoder(tokenizer, keeps_spaces).encode
        for batch in batches:
            doc_ids = batch.column(0)
            data, offsets = string_buffers(batch.column(1))
            for low, high in groups(offsets, _BLOCK):
                parts, sizes = [], []
                for a, b in groups(offsets[low : high + 1]):
                    ids, counts = encode(data, offsets[low + a : low + b + 1])
                    parts.append(np.insert(ids, np.cumsum(counts), end_id))
                    sizes.append(counts + 1)
                ids, counts = np.concatenate(parts), np.concatenate(sizes)
                wide = "<u4" if len(ids) and int(ids.max()) > 0xFFFF else "<u2"
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part], pa.int32()),
                        pa.array([block], pa.int32()),
                        pa.array([before], pa.int64()),
                        pa.array([doc_ids.slice(low, high - low).to_pylist()], pa.list_(pa.int64())),
                        pa.array([counts.tolist()], pa.list_(pa.int64())),
                        pa.array([int(wide[-1])], pa.int32()),
                        pa.array([_planes(ids.astype(wide))], pa.binary()),
                    ],
                    names=["part", "block", "before_block", "doc_ids", "sizes", "width", "ids"],
                )
                block += 1
                before += len(ids)

    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    schema = "part int, block int, before_block bigint, doc_ids array<bigint>, sizes array<bigint>, width int, ids binary"
    return written(rows.mapInArrow(blocks, schema), "token-ids")


def _planes(ids: np.ndarray) -> bytes:
    """First all low bytes, then the next ones: the file format's compression finds more to save."""
    return ids.view(np.uint8).reshape(len(ids), -1).T.tobytes()


def ids_of(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(-1).astype("<u4")


def with_offsets(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``start``: the number of ids before each block, over all partitions.

    Two passes: the totals of the partitions are summed first, one row each, then added to the places within the partition.
    """
    n = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda total, size: total + size)
    totals = tokens.groupBy("part").agg(F.max(F.col("before_block") + n).alias("total"))
    # one row per partition of the input: few enough for one task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    offsets = written(offsets, "offsets")
    return tokens.join(small_side(offsets), "part").withColumn("start", F.col("before") + F.col("before_block")).drop("before")
