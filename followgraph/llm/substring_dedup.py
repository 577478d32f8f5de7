"""Substring deduplication: passages that repeat across documents, found as paragraphs, and their removal.

Paragraphs are of two kinds, both of at least ``MIN_WORDS`` words:

* lines of the text, and shorter lines joined to the lines after them until they have as many words (``_joined``). Lines that collide in a MinHash band are verified by exact Jaccard similarity of their word shingles, and
  linked lines form clusters (components).
* windows of ``MIN_WORDS`` words that begin at anchors. An anchor is a shingle with the smallest hash among ``ANCHOR`` consecutive
  ones, so it depends on the words around it only: a passage of ``MIN_WORDS + ANCHOR`` words that stands in several documents, wherever
  it begins and whatever surrounds it, has the same window in all of them. Equal windows form a cluster.

The document with the smallest id keeps a cluster's passage; in the others it is removed. A cluster within one document is left alone.
Overlapping spans are merged. A near block is removed whole, with the few words in which it differs. Words up to ``ANCHOR`` at either end of a passage may stay.

Nulls and empty texts have no paragraphs; rows without ``doc_id`` are kept as they are; rows with the same ``doc_id`` count as one
document and lose the same words. Extra columns are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from followgraph.llm.common import linked, pack, release, settle, small_side, tidy, unpack
from followgraph.llm.shingles import gram_hashes, mixed, string_buffers, text_chunks, word_hashes
from followgraph.session import written

WIDTH = 5
PERCENT = 75
MIN_WORDS = 32
ANCHOR = 18
BANDS = 5  # of two rows each: a pair at the threshold collides with probability 1 - (1 - 0.75**2)**5 = 0.984
_ROWS = 2
_APART = 9  # words between the beginnings of blocks: 27 common shingles of 37 are below PERCENT
_BLOCK_ENTRIES = 250_000
_BUCKETS = 64  # at least
_BUCKET_ROWS = 8_000  # rows of a bucket, where there are more of them
_ODD = mixed(np.arange(1, BANDS * _ROWS + 1, dtype=np.uint64)) | np.uint64(1)


class _Chunk:
    """Words, shingles and paragraphs of some rows of a string array."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.words, self.firsts, self.places = word_hashes(data, offsets)
        self.grams, self.edges = gram_hashes(self.words, self.firsts, WIDTH)
        self._data = data
        self._offsets = offsets

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, words and key of each long line and of each block of joined lines."""
        begin, end = self._offsets[0], self._offsets[-1]
        breaks = np.flatnonzero(self._data[begin:end] == 10) + begin
        cuts = np.unique(np.concatenate([self.firsts, np.searchsorted(self.places, breaks)]))
        sizes = np.diff(cuts)
        first, end = self._joined(cuts)
        starts = np.concatenate([cuts[:-1][sizes >= MIN_WORDS], first])
        sizes = np.concatenate([sizes[sizes >= MIN_WORDS], end - first])
        texts = np.searchsorted(self.firsts, starts, "right") - 1
        return texts, starts, sizes, self._keys(starts, sizes)

    def _joined(self, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and end of blocks that begin with a short line, from the beginnings and ends of all lines.

        A block takes whole lines until it has ``MIN_WORDS`` words, of a long line only so many. Where lines begin close to each other
        only the one with the smallest hash begins a block, and of blocks with the same end the shortest stays, so that blocks depend on
        the words in and around them only, and two blocks that overlap in a text are never similar enough to be linked.
        """
        begins, ends = cuts[:-1], cuts[1:]
        first = begins[ends - begins < MIN_WORDS]
        text = np.searchsorted(self.firsts, first, "right") - 1
        fits = first + MIN_WORDS <= self.firsts[text + 1]
        first, text = first[fits], text[fits]
        if not len(first):
            return first, first
        code = self.grams[self.edges[text] + first - self.firsts[text]]
        least = np.ones(len(first), dtype=bool)
        for k in range(1, min(_APART, len(first))):
            near = (first[k:] - first[:-k] < _APART) & (text[k:] == text[:-k])
            after = code[k:] < code[:-k]
            least[:-k] &= ~(near & after)
            least[k:] &= ~near | after
        first = first[least]
        last = np.searchsorted(ends, first + MIN_WORDS)
        end = np.minimum(ends[last], begins[last] + MIN_WORDS)
        shortest = np.append(end[1:] != end[:-1], True)
        return first[shortest], end[shortest]

    def _keys(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """A hash of the words of each span."""
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        words = self.words[np.repeat(starts, sizes) + place]
        terms = mixed(words + mixed(place.astype(np.uint64)))
        return mixed(np.add.reduceat(terms, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))

    def spans_of_grams(self, texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First shingle and number of shingles of each span."""
        return self.edges[texts] + starts - self.firsts[texts], sizes - WIDTH + 1

    def bands(self, texts: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Band keys of each span, one row per band."""
        at, count = self.spans_of_grams(texts, starts, sizes)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        grams = self.grams[np.repeat(at, count) + place]
        edges = np.cumsum(count) - count
        least = [np.minimum.reduceat(grams * odd, edges) for odd in _ODD]
        return np.array([mixed(least[_ROWS * b] + mixed(least[_ROWS * b + 1] + np.uint64(b))) for b in range(BANDS)])

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, first word, words and key of each anchored window."""
        counts = np.diff(self.edges)
        none = np.zeros(0, dtype=np.int64)
        grams_in = MIN_WORDS - WIDTH + 1
        if len(self.grams) < ANCHOR or len(self.grams) >= 1 << 30 or not (counts >= max(ANCHOR, grams_in)).any():
            return none, none, none, np.zeros(0, dtype=np.uint64)
        # the smallest hash with its place in the low bits, over ANCHOR places by doubling
        least = (self.grams >> np.uint64(30) << np.uint64(30)) | np.arange(len(self.grams), dtype=np.uint64)
        span = 1
        while span < ANCHOR:
            step = min(span, ANCHOR - span)
            least = np.minimum(least[:-step], least[step:])
            span += step
        owner = np.repeat(np.arange(len(counts)), counts)
        inside = owner[: len(least)] == owner[ANCHOR - 1 :]
        chosen = np.zeros(len(self.grams), dtype=bool)
        chosen[(least[inside] & np.uint64((1 << 30) - 1)).astype(np.int64)] = True
        at = np.flatnonzero(chosen)
        at = at[at + grams_in <= self.edges[owner[at] + 1]]
        key = np.zeros(len(at), dtype=np.uint64)
        for offset in [*range(0, grams_in, WIDTH), grams_in - 1]:
            key = mixed(key + self.grams[at + offset])
        texts = owner[at]
        starts = at - self.edges[texts] + self.firsts[texts]
        return texts, starts, np.full(len(at), MIN_WORDS), mixed(key + np.uint64(7))


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, _Chunk]]:
    data, offsets = string_buffers(texts)
    for low, high in text_chunks(texts):
        yield low, high, _Chunk(data, offsets[low : high + 1])


def _rows_by_bucket(kind: int, keys: np.ndarray, arrays: list[np.ndarray], buckets: int) -> Iterator[tuple[int, bytes]]:
    part = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(buckets + 1))
    for b in range(buckets):
        mine = order[cuts[b] : cuts[b + 1]]
        if len(mine):
            yield kind * buckets + b, pack([keys[mine], *[a[mine] for a in arrays]])


def _paragraph_rows(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, data): per block of texts and bucket, the paragraphs' keys (kind 0) and the lines' bands (kind 1).

    A block sends each key once, with the smallest and largest document that has it, so that a frequent passage weighs
    as much as there are blocks.
    """

    def block(keys: list, docs: list, bands: list) -> Iterator[pa.RecordBatch]:
        rows = []
        if keys:
            k, d = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            last = np.append(edges[1:], len(k)) - 1
            rows += _rows_by_bucket(0, k[edges], [d[edges], d[last]], buckets)
        if bands:
            band, node, doc, n = (np.concatenate(x) for x in zip(*bands))
            # the smallest document of each band and line, whatever the order of the rows
            one = np.lexsort((doc, node, band))
            one = one[np.concatenate([[True], (np.diff(band[one]) != 0) | (np.diff(node[one]) != 0)])]
            rows += _rows_by_bucket(1, band[one], [node[one], doc[one], n[one]], buckets)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "data"]
        )

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, bands, held = [], [], [], 0
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for low, high, chunk in _chunks(batch.column(1)):
                own = doc[low:high]
                for texts, _, _, key in (chunk.windows(), lines := chunk.lines()):
                    keys.append(key)
                    ids.append(own[texts])
                    held += len(key)
                texts, starts, sizes, key = lines
                if len(texts):
                    band = chunk.bands(texts, starts, sizes)
                    n = np.tile((sizes - WIDTH + 1).astype(np.int64), BANDS)
                    bands.append((band.reshape(-1), np.tile(key, BANDS), np.tile(own[texts], BANDS), n))
                if held >= _BLOCK_ENTRIES:
                    yield from block(keys, ids, bands)
                    keys, ids, bands, held = [], [], [], 0
        if held:
            yield from block(keys, ids, bands)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(tidy(deal), "bucket int, data binary")


def _repeated(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Keys that several documents have, with the smallest."""
    settle()
    parts = [unpack(data, ["<u8", "<i8", "<i8"]) for data in rows["data"]]
    k, first, last = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(k, kind="stable")
    k, first, last = k[order], first[order], last[order]
    edges = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    first, last = np.minimum.reduceat(first, edges), np.maximum.reduceat(last, edges)
    several = first != last
    return pd.DataFrame({"key": k[edges][several].astype(np.int64), "keeper": first[several]})


def _colliding(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The lines that share a band with a different line."""
    settle()
    parts = [unpack(data, ["<u8", "<u8", "<i8", "<i8"]) for data in rows["data"]]
    band, node, doc, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((doc, node, band))
    band, node, doc, n = band[order], node[order], doc[order], n[order]
    edges = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    several = np.repeat(np.minimum.reduceat(node, edges) != np.maximum.reduceat(node, edges), np.diff(np.append(edges, len(band))))
    fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (node[1:] != node[:-1])])
    keep = several & fresh
    return pd.DataFrame(
        {"gram": band[keep].astype(np.int64), "node": node[keep].astype(np.int64), "doc_id": doc[keep], "n": n[keep]}
    )


def _line_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, n, grams) of the wanted lines, from the document that was noted for each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for low, high, chunk in _chunks(batch.column(1)):
                texts, starts, sizes, key = chunk.lines()
                at, count = chunk.spans_of_grams(texts, starts, sizes)
                grams = [np.unique(chunk.grams[a : a + c]).astype(np.int64) for a, c in zip(at, count)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.astype(np.int64)), pa.array(doc[low:high][texts], pa.int64()), pa.array(grams, pa.list_(pa.int64()))],
                    names=["node", "doc_id", "grams"],
                )

    some = docs.select(F.col("doc_id").cast("bigint"), "text")
    some = some.join(small_side(written(nodes.select("doc_id").distinct(), "line-docs")), "doc_id", "left_semi")
    rows = some.mapInArrow(tidy(sets), "node bigint, doc_id bigint, grams array<bigint>")
    rows = rows.join(small_side(nodes, 32), ["node", "doc_id"], "left_semi").dropDuplicates(["node"])
    n = F.size("grams").cast("bigint")
    return written(rows.select("node", n.alias("n"), F.lit(1).cast("bigint").alias("weight"), "grams"), "line-sets")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, removed, keep_doc_id, cluster_id): the words of each document that repeat elsewhere.

    ``start`` and ``length`` count words; ``removed`` is false in the document that keeps the passage. ``keep_doc_id`` and
    ``cluster_id`` are those of the first of several merged paragraphs.
    """
    buckets = max(_BUCKETS, docs.count() // _BUCKET_ROWS)
    rows = written(_paragraph_rows(docs, buckets), "paragraphs")
    repeated = rows.where(f"bucket < {buckets}").groupBy("bucket").applyInPandas(_repeated, "key bigint, keeper bigint")
    repeated = written(repeated, "repeated")
    postings = rows.where(f"bucket >= {buckets}").groupBy("bucket").applyInPandas(
        _colliding, "gram bigint, node bigint, doc_id bigint, n bigint"
    )
    postings = written(postings, "postings")
    release(rows)
    nodes = written(postings.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    sets = _line_sets(docs, nodes)
    labels, _ = linked(postings.select("node", "gram").distinct(), sets, PERCENT)
    release(postings)
    release(sets)
    members = labels.union(labels.select(F.col("component").alias("node"), "component").distinct())
    members = written(members.join(nodes, "node"), "members")
    keepers = members.groupBy("component").agg(F.min("doc_id").alias("keeper"))
    clusters = members.select(F.col("node").alias("key"), F.col("component").alias("cluster")).join(
        keepers.withColumnRenamed("component", "cluster"), "cluster"
    )
    alone = repeated.join(members.select(F.col("node").alias("key")), "key", "left_anti")
    clusters = written(clusters.select("key", "cluster", "keeper").union(alone.select("key", F.col("key").alias("cluster"), "keeper")), "clusters")
    release(repeated)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for low, high, chunk in _chunks(batch.column(1)):
                for texts, starts, sizes, key in (chunk.windows(), chunk.lines()):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(key.astype(np.int64)),
                            pa.array(doc[low:high][texts], pa.int64()),
                            pa.array(starts - chunk.firsts[texts], pa.int64()),
                            pa.array(sizes.astype(np.int64)),
                        ],
                        names=["key", "doc_id", "start", "length"],
                    )

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    found = texts.mapInArrow(tidy(occurrences), "key bigint, doc_id bigint, start bigint, length bigint").join(small_side(clusters, 24), "key")
    found = found.withColumn("removed", F.col("doc_id") != F.col("keeper"))
    # merge what overlaps
    by_doc = Window.partitionBy("doc_id", "removed").orderBy("start", "length", "cluster")
    reach = F.max(F.col("start") + F.col("length")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start", "length", "keeper", "cluster"))
    return islands.groupBy("doc_id", "removed", "island").agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("end"), first.alias("first")
    ).select(
        "doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "removed",
        F.col("first.keeper").alias("keep_doc_id"), F.col("first.cluster").alias("cluster_id"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed passages cut out of ``text``; all rows and columns stay.

    Lines around a cut keep their breaks; a text that loses all its words is empty.
    """
    spans = repeated_spans(docs).where("removed").groupBy("doc_id").agg(F.collect_list(F.struct("start", "length")).alias("_cuts"))
    spans = written(spans.withColumnRenamed("doc_id", "_doc"), "cuts")
    joined = docs.join(small_side(spans, 64), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")
    schema = docs.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = batch.column(batch.num_columns - 1).to_pylist()
            at = schema.names.index("text")
            texts = batch.column(at)
            data, offsets = string_buffers(texts)
            out = texts.to_pylist()
            for row, spans in enumerate(cuts):
                if spans:
                    out[row] = _without(data, offsets[row : row + 2], spans)
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(tidy(cut), schema)


def _without(data: np.ndarray, offsets: np.ndarray, spans: list[dict]) -> str:
    _, _, places = word_hashes(data, offsets)
    places = np.append(places, offsets[1])
    keep, at = [], int(offsets[0])
    for span in sorted(spans, key=lambda s: s["start"]):
        begin, end = int(places[span["start"]]), int(places[span["start"] + span["length"]])
        if begin > at:
            keep.append(data[at:begin].tobytes())
        gap = data[begin:end]
        if len(gap) and gap[-1] == 10:
            keep.append(b"\n")
        at = max(at, end)
    keep.append(data[at : int(offsets[1])].tobytes())
    text = b"".join(keep).decode()
    return text if text.strip() else ""
