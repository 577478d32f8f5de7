"""Token ids in binary files: canonical Huffman codes of limited length, from counts over the whole corpus.

Files: ``<path>/codebook`` (id, bits) holds the code lengths; the codes follow from them, shorter codes first and equal lengths by id.
``<path>/blocks`` (first_id, start, doc_ids, sizes, checkpoints, payload) holds independent blocks of whole documents in ascending ``doc_id`` order.
The payload is the codes one after the other, the first bit highest. ``checkpoints`` are the bits that each run of ``LANE`` ids takes, as
unsigned 16-bit numbers; a reader sums them to enter every run at once, and decodes each id by one look into a table of all
bit patterns of the longest length.

Null texts are empty and give the closing id only. Rows without ``doc_id`` come first. Rows with the same ``doc_id`` stand one after the other
in the order of a hash of their texts. Empty tables give no block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from followgraph.llm.common import release
from followgraph.llm.token_table import ids_of, token_table, with_offsets

END = 2
LIMIT = 16
LANE = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of the best prefix code with no length over ``limit``, by package and merge.

    ``limit`` grows where the symbols are too many for it.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, dtype=np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    weights = counts[order].astype(np.float64)
    # per level, the sorted list of leaves and packages; then the 2n - 2 cheapest of the last level are followed back
    levels = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for leaves in reversed(levels):
        chosen = int(leaves[:take].sum())
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out = np.zeros(n, dtype=np.int64)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes of symbols with these lengths."""
    codes = np.zeros(len(lengths), dtype=np.int64)
    code = previous = 0
    for symbol in np.lexsort((np.arange(len(lengths)), lengths)):
        code <<= int(lengths[symbol]) - previous
        previous = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def by_id(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and codes with their first bit at the top of 64, with the id as index."""
    sizes, words = np.zeros(int(symbols.max(initial=0)) + 1, dtype=np.uint8), np.zeros(int(symbols.max(initial=0)) + 1, dtype=np.uint64)
    sizes[symbols], words[symbols] = lengths, codes.astype(np.uint64) << (64 - lengths).astype(np.uint64)
    return sizes, words


def encode_block(ids: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """(payload, checkpoints) of the ids, by the tables of ``by_id``."""
    if not len(ids):
        return b"", b""
    size, code = sizes[ids], words[ids]
    ends = np.cumsum(size, dtype=np.int64)
    begins = ends - size
    word, place = begins >> 6, (begins & 63).astype(np.uint8)
    out = np.zeros(int(ends[-1] >> 6) + 2, dtype=np.uint64)
    edges = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[edges]] = np.add.reduceat(code >> place.astype(np.uint64), edges)
    over = np.flatnonzero(place + size > 64)
    out[word[over] + 1] |= code[over] << (64 - place[over]).astype(np.uint64)  # at most one code runs into a word
    bits = np.add.reduceat(size, np.arange(0, len(size), LANE), dtype=np.int64)
    return out.astype(">u8").tobytes()[: (int(ends[-1]) + 7) // 8], bits.astype("<u2" if bits.max() < 65536 else "<u4").tobytes()


def decoding_table(symbols: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(longest, id, length) for every bit pattern of the longest length."""
    longest = int(lengths.max(initial=1))
    ids, sizes = np.zeros(1 << longest, dtype=np.uint32), np.ones(1 << longest, dtype=np.uint8)
    order = np.argsort(codes << (longest - lengths), kind="stable")
    spans = np.left_shift(1, longest - lengths[order])
    filled = int(spans.sum())
    ids[:filled] = np.repeat(symbols[order], spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return longest, ids, sizes


def decode_block(payload: bytes, checkpoints: bytes, n: int, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ``n`` ids of a block, all runs at once."""
    longest, ids, sizes = table
    lanes = -(-n // LANE)
    if not lanes:
        return np.zeros(0, dtype="<u4")
    bits = np.frombuffer(checkpoints, dtype=f"<u{len(checkpoints) // lanes}").astype(np.int64)
    at = np.cumsum(bits) - bits
    data = np.frombuffer(payload + b"\0" * 8, dtype=np.uint8)
    # each byte's next four bytes as one number
    wide = data[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        wide = (wide << np.uint32(8)) | data[k : len(data) - 3 + k]
    out = np.zeros((LANE, lanes), dtype="<u4")
    last = len(wide) - 1
    mask = np.uint32((1 << longest) - 1)
    for step in range(LANE):
        window = (wide[np.minimum(at >> 3, last)] >> (32 - longest - (at & 7)).astype(np.uint32)) & mask
        out[step] = ids[window]
        at = at + sizes[window]
    return out.T.reshape(-1)[:n]


def write_files(docs: DataFrame, tokenizer: str, path: str, keeps_spaces: bool = False, end_id: int = END) -> None:
    """Encode all documents into files under ``path``."""
    spark = docs.sparkSession
    # the hash spreads rows without doc_id, or with the same one, over partitions
    order = ["doc_id", F.xxhash64("text")]
    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    tokens = token_table(ordered, tokenizer, keeps_spaces, end_id)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for width, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.bincount(ids_of(data, width))
                total = np.pad(total, (0, max(0, len(own) - len(total))))
                total[: len(own)] += own
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counts = tokens.select("width", "ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counts.orderBy("id").toPandas()  # one row for each id of the vocabulary at most
    symbols = counts["id"].to_numpy(dtype=np.int64)
    lengths = code_lengths(counts["n"].to_numpy(dtype=np.int64))
    codes = canonical_codes(lengths)
    book = [(int(i), int(b)) for i, b in zip(symbols, lengths)]
    spark.createDataFrame(book, "id bigint, bits int").coalesce(1).write.parquet(f"{path}/codebook")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, words = by_id(symbols, lengths, codes)
        for batch in batches:
            for row in batch.to_pylist():
                payload, checkpoints = encode_block(ids_of(row["ids"], row["width"]), sizes, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["doc_ids"][0]], pa.int64()),
                        pa.array([row["start"]], pa.int64()),
                        pa.array([row["doc_ids"]], pa.list_(pa.int64())),
                        pa.array([row["sizes"]], pa.list_(pa.int64())),
                        pa.array([checkpoints], pa.binary()),
                        pa.array([payload], pa.binary()),
                    ],
                    names=["first_id", "start", "doc_ids", "sizes", "checkpoints", "payload"],
                )

    schema = "first_id bigint, start bigint, doc_ids array<bigint>, sizes array<bigint>, checkpoints binary, payload binary"
    blocks = with_offsets(tokens).select("doc_ids", "sizes", "width", "ids", "start").mapInArrow(encode, schema)
    blocks.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    release(tokens)


def read_files(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document in the files."""
    book = spark.read.parquet(f"{path}/codebook").orderBy("id").toPandas()
    symbols, lengths = book["id"].to_numpy(dtype=np.int64), book["bits"].to_numpy(dtype=np.int64)
    table = decoding_table(symbols, lengths, canonical_codes(lengths))
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["sizes"], dtype=np.int64)
                ids = decode_block(row["payload"], row["checkpoints"], int(sizes.sum()), table)
                ends = np.cumsum(sizes)
                raw = ids.tobytes()
                spans = list(zip((ends - sizes).tolist(), ends.tolist()))
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - sizes),
                    pa.array(sizes),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([ids[a:b].tolist() for a, b in spans], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"{n} bigint" for n in names[:4]) + ", ids array<bigint>" * with_ids
    blocks = spark.read.parquet(f"{path}/blocks").select("start", "doc_ids", "sizes", "checkpoints", "payload")
    return blocks.mapInArrow(decode, schema)
