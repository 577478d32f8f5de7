"""Concatenate and cut: all documents become one long row of ids, which is cut into sequences of a fixed length.

Every document is followed by the id 0. The order is that of the partitions of the input and, inside, of their rows; two passes of prefix
sums over the partitions' totals give every document its place. Only the last sequence can be shorter than ``LENGTH``;
it is padded unless its length is a power of two. A document that crosses a border lies in several pieces.

A null text is empty and gives the closing id only. Rows without ``doc_id`` are packed, too, under a null. Repeated rows are packed
as often as they come. Empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from followgraph.llm.token_table import ids_of, token_table, with_offsets

LENGTH = 1024
END = 0


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of all documents.

    ``start`` counts the document's ids before the piece, ``offset`` the sequence's. ``with_ids`` adds the ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, sizes, width, data, start in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                ids = ids_of(data, width)
                sizes = np.array(sizes, dtype=np.int64)
                first = np.cumsum(sizes) - sizes
                # a piece begins at every document and at every multiple of the length
                borders = np.arange(-(-start // length) * length, start + len(ids), length) - start
                begin = np.union1d(first, borders)
                end = np.append(begin[1:], len(ids))
                doc = np.searchsorted(first, begin, "right") - 1
                place = start + begin
                raw = ids.tobytes()
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
                columns = [
                    pa.array(doc_ids, pa.int64()).take(pa.array(doc)),
                    pa.array(begin - first[doc]),
                    pa.array(end - begin),
                    pa.array(sums, pa.int64()),
                    pa.array(sizes[doc]),
                    pa.array(place // length),
                    pa.array(place % length),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in zip(begin, end)], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = ", ".join(f"{n} bigint" for n in names[:7]) + ", ids array<bigint>" * with_ids
    placed = with_offsets(token_table(docs, tokenizer, True, END))
    return placed.select("doc_ids", "sizes", "width", "ids", "start").mapInArrow(cut, schema)
