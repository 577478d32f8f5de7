"""N-gram Jaccard join: exact links between documents whose word shingles overlap by a threshold, and their components.

The distinct shingles of all documents stand in one global order, which is cut into fragments.

1. Every document is reduced to its set of shingle hashes; documents with equal sets form one class.
2. Order by hash. If J(a, b) >= t, then a and b share at least l shingles among the first n - ceil(t n) + l ones of either
   set. The fragments of this order are counted apart: each says how many shingles of a class are known to
   another class, and the sums per class leave only the classes that can have a link at all.
3. For the rest, the order is by document frequency, rarest first. Classes that share a shingle of their prefix are candidates. Candidates
   meet in tiles of bounded size, where every fragment's partial overlaps are counted apart and summed per pair.

All links are found, and pairs never become rows: see ``common.linked``.

Nulls, empty texts and white space give the empty set: no links, a component of its own. Rows with the same
``doc_id`` are one node. Rows without ``doc_id`` take no part. Ties are settled by the smaller id. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from followgraph.llm.common import linked, pack, release, settle, small_side, unpack
from followgraph.llm.shingles import gram_sets
from followgraph.session import written

WIDTH = 5
PERCENT = 75
_BLOCK_GRAMS = 1_000_000
_FRAGMENT_GRAMS = 2_000_000
_SHARED = np.uint32(0xFFFFFFFF)  # marks a shingle of several classes of the same block


def _set_key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=8).digest()


def shingle_sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, set_key): size and a 64-bit digest of every document's set; no digest for an empty set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            sizes, keys = [], []
            for _, grams in gram_sets(batch.column(1), width):
                sizes.append(len(grams))
                keys.append(int.from_bytes(_set_key(grams), "little", signed=True) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64())], names=["doc_id", "n_shingles", "set_key"]
            )

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(sets, "doc_id bigint, n_shingles bigint, set_key bigint")


def _prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of the prefix by hash, and the fewest shared shingles in it that a linked partner implies."""
    need = -(-percent * n // 100)
    extra = max(1, n // 4)
    return n - need + extra, max(1, need // 4)


def _known_shingles(docs: DataFrame, total: int, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(set_key, known): how many shingles of its prefix each class shares with others; and the written table behind it."""
    fragments = max(64, -(-total // (2 * _FRAGMENT_GRAMS)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        block: dict[int, np.ndarray] = {}
        held = 0
        for batch in batches:
            for _, grams in gram_sets(batch.column(0), width):
                if not len(grams):
                    continue
                key = int.from_bytes(_set_key(grams), "little", signed=True)
                if key not in block:
                    block[key] = grams[: _prefix(len(grams), percent)[0]].copy()
                    held += len(block[key])
                if held >= _BLOCK_GRAMS:
                    yield from _fragment_rows(block, fragments)
                    block, held = {}, 0
        if block:
            yield from _fragment_rows(block, fragments)

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        hashes, classes = [], []
        for data in rows["data"]:
            h, counts, names = unpack(data, ["<u4", "<u4", "<i8"])
            hashes.append(h)
            classes.append(np.repeat(names, counts))
        h, c = np.concatenate(hashes), np.concatenate(classes)
        order = np.argsort(h, kind="stable")
        h, c = h[order], c[order]
        edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        sizes = np.diff(np.append(edges, len(h)))
        # known to several classes: two different ones (the mark of a block counts as one that is always different)
        low, high = np.minimum.reduceat(c, edges), np.maximum.reduceat(c, edges)
        several = np.repeat((low != high) | (low == 0), sizes)
        names, counts = np.unique(c[several & (c != 0)], return_counts=True)
        return pd.DataFrame({"set_key": names, "known": counts.astype(np.int64)})

    dealt = docs.select("text").mapInArrow(deal, "fragment int, data binary, set_key bigint, known bigint")
    dealt = written(dealt, "fragments")
    partial = dealt.where("fragment >= 0").groupBy("fragment").applyInPandas(count, "set_key bigint, known bigint")
    own = dealt.where("fragment < 0").select("set_key", "known")
    return partial.union(own).groupBy("set_key").agg(F.sum("known").alias("known")), dealt


def _fragment_rows(block: dict[int, np.ndarray], fragments: int) -> Iterator[pa.RecordBatch]:
    """One row per fragment with the hashes that one class of the block has, one for those that several have.

    Shingles that several classes of the block have are known already: they are sent once, and counted here.
    """
    names = np.array(list(block), dtype=np.int64)
    grams = np.concatenate(list(block.values()))
    owner = np.repeat(np.arange(len(names), dtype=np.uint32), [len(g) for g in block.values()])
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    edges = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(edges, len(ordered)))
    single = order[edges[sizes == 1]]
    several = ordered[edges[sizes > 1]]
    known = np.bincount(owner[order[np.repeat(sizes > 1, sizes)]], minlength=len(names))
    # back to the order of the classes, so that a row holds each class once
    single.sort()
    hashes = np.concatenate([grams[single], several])
    owners = np.concatenate([owner[single], np.full(len(several), _SHARED, dtype=np.uint32)])
    part = (hashes % np.uint64(fragments)).astype(np.int64)
    short = ((hashes // np.uint64(fragments)) & np.uint64(0xFFFFFFFF)).astype("<u4")
    by_part = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[by_part], np.arange(fragments + 1))
    ids, rows = [], []
    for f in range(fragments):
        mine = by_part[cuts[f] : cuts[f + 1]]
        if len(mine):
            o = owners[mine]
            begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
            counts = np.diff(np.append(begin, len(o))).astype("<u4")
            classes = np.where(o[begin] == _SHARED, 0, names[np.minimum(o[begin], len(names) - 1)]).astype("<i8")
            ids.append(f)
            rows.append(pack([short[mine], counts, classes]))
    some = np.flatnonzero(known)
    fields = [("fragment", pa.int32()), ("data", pa.binary()), ("set_key", pa.int64()), ("known", pa.int64())]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(ids + [-1] * len(some), pa.int32()),
            pa.array(rows + [None] * len(some), pa.binary()),
            pa.array([None] * len(ids) + names[some].tolist(), pa.int64()),
            pa.array([None] * len(ids) + known[some].tolist(), pa.int64()),
        ],
        schema=pa.schema(fields),
    )


def _shared_sets(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(node, n, weight, grams, rare): the shingles of every class that another one has, and the rarest that are its prefix; and
    the written table behind it.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        for batch in batches:
            lists = [g.astype(np.int64) for _, g in gram_sets(batch.column(1), width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], names=["node", "grams"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text").join(small_side(classes.select("node")), "node", "left_semi")
    sets = texts.mapInArrow(grams, "node bigint, grams array<bigint>").dropDuplicates(["node"])
    sets = written(sets, "sets")
    elements = sets.select("node", F.explode("grams").alias("gram"))
    frequency = elements.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    shared = elements.join(frequency, "gram").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("order"))
    prefix = F.expr(f"size(order) - cast(ceil({percent} * n / 100) as bigint) + 1").cast("int")
    grams = F.array_sort(F.transform("order", lambda x: x["gram"]))
    rare = F.transform(F.slice("order", 1, F.col("prefix")), lambda x: x["gram"])
    rows = shared.join(classes, "node").withColumn("prefix", prefix).where("prefix > 0")
    return rows.select("node", "n", "weight", grams.alias("grams"), rare.alias("rare")), sets


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row with a doc_id; ``n_links`` counts rows. See the module's notes."""
    sets = written(shingle_sets(docs, width), "shingle-sets")
    classes = sets.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.count("*").alias("weight")
    )
    classes = written(classes, "classes")
    total = sets.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).head()[0]
    known, dealt = _known_shingles(docs.where("doc_id is not null"), total, width, percent)
    enough = F.expr(f"known >= greatest(1, cast(floor(ceil({percent} * n / 100) / 4) as bigint))")
    linkable = written(classes.join(known, "set_key").where(enough).select("node", "n", "weight"), "linkable")
    release(dealt)
    shared, own = _shared_sets(docs, linkable, width, percent)
    shared = written(shared, "shared")
    release(own)
    postings = written(shared.select("node", F.explode("rare").alias("gram")), "postings")
    labels, links = linked(postings, shared.drop("rare"), percent)
    release(postings)
    release(shared)
    joined = sets.join(classes.select("set_key", "node", "weight"), "set_key", "left").withColumn("node", F.coalesce("node", "doc_id"))
    copies = F.coalesce(F.col("weight") - 1, F.lit(0))
    return joined.join(labels, "node", "left").join(links, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"),
        (copies + F.coalesce("n_links", F.lit(0))).alias("n_links"),
    )


def one_per_group(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that are linked, directly or not, to one with a smaller id.

    Rows without doc_id are kept.
    """
    groups = link_components(docs, width, percent)
    gone = written(groups.where("component_id != doc_id").select("doc_id").distinct(), "copies")
    return docs.join(small_side(gone), "doc_id", "left_anti").select(*docs.columns)
