"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from followgraph.session import written

_BROADCAST_ROWS = 2_000_000


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_side(df: DataFrame, row_bytes: int = 16) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows fit in 32 MB, else unchanged.

    ``df`` should be a written table, so that counting it is cheap. Beyond the bound the join shuffles.
    """
    return F.broadcast(df) if df.count() * row_bytes <= 16 * _BROADCAST_ROWS else df


def release(table: DataFrame) -> None:
    """Delete the files of a written table once everything that reads it has been written itself."""
    spark = table.sparkSession
    for folder in {name.rpartition("/")[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle() -> None:
    """Give back memory that earlier tasks left in this worker: what tokenizers keep between tasks, and blocks that were freed.

    Spark uses workers again for other operators, so an operator that needs much memory calls this at the beginning of a task.
    """
    for name, kept in (("tokens", "_encoders"), ("boundary_bpe", "_codecs")):
        if module := sys.modules.get(f"followgraph.llm.{name}"):
            getattr(module, kept).clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def tidy(function: Callable) -> Callable:
    """A function over batches that settles before and after: a worker waits for its next task without what this one used."""

    def run(batches: Iterator) -> Iterator:
        settle()
        yield from function(batches)
        settle()

    return run


def pack(arrays: Sequence[np.ndarray]) -> bytes:
    """Arrays as one byte string: their lengths in bytes, then their bytes."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(p) for p in parts], dtype="<u8").tobytes() + b"".join(parts)


def unpack(data: bytes, dtypes: Sequence[str]) -> list[np.ndarray]:
    """What ``pack`` was given, with these types."""
    sizes = np.frombuffer(data, dtype="<u8", count=len(dtypes))
    out, at = [], 8 * len(dtypes)
    for size, dtype in zip(sizes, dtypes):
        out.append(np.frombuffer(data, dtype=dtype, count=int(size) // np.dtype(dtype).itemsize, offset=at))
        at += int(size)
    return out


def components(edges: DataFrame, left: str, right: str, label: str = "links") -> DataFrame:
    """(node, component): every node of the edges that isn't the smallest of its component, with that smallest node.

    Alternating star contraction, until every node has one edge, to the root of its star. Each round writes the edges to the shared folder, so a
    lost executor repeats one round only; the rounds grow with the logarithm of the longest path, and no neighbour list is collected. A round's plan has three
    shuffles and no join, as the driver keeps plans, stages and a thread for every shuffle of the last minute.
    """
    edges = edges.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("hi"), F.least(left, right).alias("lo")
    )
    edges = written(edges.distinct(), label)
    while not _stars(edges):
        both = edges.select(F.expr("inline(array(struct(hi as u, lo as v), struct(lo as u, hi as v)))"))
        # larger neighbours go to the smallest one, and so does the node itself
        least = F.least("u", F.min("v").over(Window.partitionBy("u")))
        larger = both.withColumn("lo", least).where("v > u or v = lo").select(F.greatest("u", "v").alias("hi"), "lo")
        # then smaller neighbours
        pairs = larger.withColumn("m", F.min("lo").over(Window.partitionBy("hi")))
        smaller = pairs.select(F.when(F.col("lo") == F.col("m"), F.col("hi")).otherwise(F.col("lo")).alias("hi"), F.col("m").alias("lo"))
        edges = written(smaller.distinct(), label)
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether no node has two edges to smaller ones, or edges to smaller and to larger ones."""
    ends = edges.select(F.expr("inline(array(struct(hi as node, 1 as up, 0 as down), struct(lo as node, 0 as up, 1 as down)))"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


_TILE_NODES = 256
_TILE_GRAMS = 1 << 18
_FRAGMENT_GRAMS = 1 << 20  # elements of a large group that a task counts at once
_LONE_ROUNDS = 8
_MANY = 20  # with fewer than 1/20 of the nodes gone, they aren't counted again
_FRAGMENT = 4096
_BATCH_GRAMS = 1 << 21  # elements of the small groups that are verified together
_FEW = 24  # sets of a group up to which pairs are counted from sorted elements instead of a matrix

_LINKS = "node bigint, low bigint, n_links bigint"


def linked(postings: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links between sets that share a key: (node, component) without the components' smallest nodes, and (node, n_links).

    ``postings`` (node, gram) says which nodes share which key, ``sets`` (node, n, weight, grams) has their sizes, weights and, in
    ascending order, the elements that any other set may have. ``n_links`` sums the weights of the linked nodes.

    Nodes that share keys, directly or not, form a candidate group. Groups that fit in one block are verified many at a time, and their components are
    known there. A larger group loses the nodes that can link with no other (``_lone_nodes``) and is dealt to blocks of bounded size, and each pair of blocks with a common key is one tile. Inside a tile the
    elements are cut into fragments; the partial overlaps of a fragment are one matrix product, and their sum per pair decides. Pairs never
    become rows: a tile returns a forest of its links and the links per node.
    """
    first = postings.groupBy("gram").agg(F.min("node").alias("b"))
    groups = components(postings.join(first, "gram").select("node", "b"), "node", "b", "groups")
    nodes = sets.select("node", F.size("grams").alias("size")).join(groups, "node", "left")
    nodes = written(nodes.select("node", "size", F.coalesce("component", "node").alias("group")), "group-nodes")
    weighty = _block_counts(nodes)
    lone = _lone_nodes(nodes.join(small_side(weighty.where("blocks > 1")), "group").select("node", "group", "size"), sets, percent)
    if not lone.isEmpty():
        nodes = written(nodes.join(small_side(lone), "node", "left_anti"), "group-nodes")
        weighty = _block_counts(nodes)
    dealt = nodes.join(small_side(weighty), "group")
    block = F.expr("pmod(xxhash64(node), blocks)").cast("int").alias("block")
    dealt = written(dealt.select("node", "group", "size", "blocks", block), "blocks")

    whole = dealt.where("blocks = 1")
    entries = whole.agg(F.sum("size")).head()[0] or 0
    batches = max(1, -(-entries // _BATCH_GRAMS))
    whole = whole.select("node", "group", F.expr(f"pmod(xxhash64(group), {batches})").alias("batch"))
    found_whole = whole.join(sets, "node").groupBy("batch").applyInPandas(lambda rows: _groups_links(rows, percent), _LINKS)
    found_whole = written(found_whole, "links")

    large = dealt.where("blocks > 1").drop("size", "blocks")
    by_gram = postings.join(large, "node").groupBy("gram", "group").agg(F.array_sort(F.collect_set("block")).alias("blocks"))
    pairs = F.expr("flatten(transform(blocks, i -> transform(filter(blocks, j -> j >= i), j -> struct(i as i, j as j))))")
    tiles = by_gram.select("group", "blocks").distinct().select("group", F.explode(pairs).alias("t")).select("group", "t.i", "t.j")
    tiles = written(tiles.distinct(), "tiles")
    sides = tiles.select("group", "i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).union(
        tiles.where("i < j").select("group", "i", "j", F.col("j").alias("block"), F.lit(1).alias("side"))
    )
    rows = sides.join(large, ["group", "block"]).select("group", "i", "j", "side", "node").join(sets, "node")

    def tile(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _tile_links(rows[rows["side"] == 0].reset_index(drop=True), rows[rows["side"] == 1].reset_index(drop=True), percent)

    found = written(rows.groupBy("group", "i", "j").applyInPandas(tile, _LINKS), "links")
    for table in (nodes, weighty, dealt, tiles):
        release(table)
    known = found_whole.where("node != low").select("node", F.col("low").alias("component"))
    counts = found_whole.unionByName(found).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    return known.unionByName(components(found, "node", "low", "linked")), counts


def _block_counts(nodes: DataFrame) -> DataFrame:
    """(group, blocks) of the groups with several nodes, as a written table."""
    weighty = nodes.groupBy("group").agg(F.count("*").alias("members"), F.sum("size").alias("size")).where("members > 1")
    blocks = F.greatest(F.ceil(F.col("members") / _TILE_NODES), F.ceil(F.col("size") / _TILE_GRAMS)).cast("int")
    return written(weighty.select("group", blocks.alias("blocks")), "group-blocks")


def _lone_nodes(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node): the nodes of large groups that too few of their elements would let link with any other of their group, as a written table.

    Two linked sets have ``percent`` of each in common, so a set of which fewer elements stand in others of its group has no link. A fragment of a group's elements
    counts them, and sends only the sets that have elements of their own there. What goes takes elements from others, so the rest is asked again while many go.
    """
    gone: DataFrame | None = None
    for _ in range(_LONE_ROUNDS):
        rest = large if gone is None else large.join(small_side(gone), "node", "left_anti")
        fragments = rest.groupBy("group").agg(F.ceil(F.sum("size") / _FRAGMENT_GRAMS).cast("int").alias("fragments"), F.count("*").alias("members"))
        fragments = written(fragments, "group-fragments")
        members = fragments.agg(F.sum("members")).head()[0] or 0
        if not members:
            break
        rows = rest.join(small_side(fragments.select("group", "fragments")), "group").select("node", "group", "fragments").join(sets, "node")
        packs = rows.select("node", "group", "fragments", "grams").mapInPandas(_fragments_of, "group bigint, fragment int, data binary")
        own = packs.groupBy("group", "fragment").applyInPandas(_own_elements, "node bigint, own bigint").groupBy("node").agg(F.sum("own").alias("own"))
        few = rest.join(own, "node").join(sets.select("node", "n"), "node").where(f"100 * (size - own) < {percent} * n").select("node")
        few = written(few, "lone")
        number = few.count()
        gone = few if gone is None else gone.union(few)
        if number * _MANY < members:
            break
    return large.sparkSession.createDataFrame([], "node bigint") if gone is None else written(gone, "lone")


def _fragments_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Elements and nodes of some sets, one row for each group and fragment."""
    for rows in frames:
        out = []
        for group, some in rows.groupby("group"):
            gram = np.concatenate([np.asarray(g, dtype=np.int64) for g in some["grams"]])
            node = np.repeat(some["node"].to_numpy(), some["grams"].map(len).to_numpy())
            part = (gram.view(np.uint64) % np.uint64(some["fragments"].iloc[0])).astype(np.int64)
            for fragment in np.unique(part):
                mine = part == fragment
                out.append((group, int(fragment), pack([gram[mine], node[mine]])))
        yield pd.DataFrame(out, columns=["group", "fragment", "data"])


def _own_elements(rows: pd.DataFrame) -> pd.DataFrame:
    """How many elements of each node no other node has, for the nodes that have such."""
    gram, node = (np.concatenate(x) for x in zip(*[unpack(data, ["<i8", "<i8"]) for data in rows["data"]]))
    _, at, counts = np.unique(gram, return_index=True, return_counts=True)
    nodes, own = np.unique(node[at[counts == 1]], return_counts=True)
    return pd.DataFrame({"node": nodes, "own": own})


def _tile_links(own: pd.DataFrame, other: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(node, low, n_links) of the links between two blocks, or inside one if the other is empty; ``low`` is the smallest node that links lead to."""
    same = not len(other)
    if same:
        other = own
    common = _overlaps(own["grams"], own["grams"] if same else other["grams"])
    sizes = own["n"].to_numpy()[:, None] + other["n"].to_numpy()[None, :]
    links = 100 * common >= percent * (sizes - common)
    if same:
        np.fill_diagonal(links, False)
    a, b = own["node"].to_numpy(), other["node"].to_numpy()
    counts = [(a, links @ other["weight"].to_numpy())] + ([] if same else [(b, links.T @ own["weight"].to_numpy())])
    # smallest linked node, again and again, until nothing changes
    least_a, least_b = a.copy(), b.copy()
    while True:
        top = np.iinfo(np.int64).max
        new_a = np.minimum(least_a, np.where(links, least_b[None, :], top).min(axis=1))
        new_b = np.minimum(least_b, np.where(links, new_a[:, None], top).min(axis=0))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if (new_a == least_a).all() and (new_b == least_b).all():
            break
        least_a, least_b = new_a, new_b
    pairs = [(a, least_a)] + ([] if same else [(b, least_b)])
    node = np.concatenate([x for x, _ in pairs])
    low = np.concatenate([y for _, y in pairs])
    n = np.concatenate([c for _, c in counts]).astype(np.int64)
    keep = (n > 0) | (node != low)
    return pd.DataFrame({"node": node[keep], "low": low[keep], "n_links": n[keep]})


def _groups_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """``_tile_links`` of many whole groups at once; ``low`` is the smallest node of the component."""
    members = rows["group"].map(rows["group"].value_counts()).to_numpy()
    parts = [_tile_links(some.reset_index(drop=True), rows.iloc[:0], percent) for _, some in rows[members > _FEW].groupby("group")]
    rows = rows[members <= _FEW].sort_values(["group", "node"]).reset_index(drop=True)
    if len(rows):
        parts.append(_small_groups_links(rows, percent))
    return pd.concat(parts) if parts else pd.DataFrame({"node": [], "low": [], "n_links": []}).astype("int64")


def _small_groups_links(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    node, n, weight = (rows[c].to_numpy() for c in ("node", "n", "weight"))
    sizes = rows["grams"].map(len).to_numpy()
    owner = np.repeat(np.arange(len(rows)), sizes)
    group = np.unique(rows["group"].to_numpy(), return_inverse=True)[1]
    flat = np.concatenate([np.asarray(g, dtype=np.int64) for g in rows["grams"]])
    # elements of a group that are equal stand together, their sets in ascending order
    order = np.lexsort((owner, flat, group[owner]))
    owner, flat = owner[order], flat[order]
    keys = [np.zeros(0, dtype=np.int64)]
    at = np.arange(len(flat))
    for apart in range(1, _FEW):
        at = at[at + apart < len(flat)]
        at = at[(flat[at] == flat[at + apart]) & (group[owner[at]] == group[owner[at + apart]])]
        if not len(at):
            break
        keys.append(owner[at] * len(rows) + owner[at + apart])
    pairs, common = np.unique(np.concatenate(keys), return_counts=True)
    a, b = pairs // len(rows), pairs % len(rows)
    links = 100 * common >= percent * (n[a] + n[b] - common)
    a, b = a[links], b[links]
    low, n_links = node.copy(), np.zeros(len(rows), dtype=np.int64)
    np.add.at(n_links, a, weight[b])
    np.add.at(n_links, b, weight[a])
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            break
    keep = n_links > 0
    return pd.DataFrame({"node": node[keep], "low": low[keep], "n_links": n_links[keep]})


def _overlaps(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Common elements of every left set with every right set; fragments of the order are counted apart and summed."""
    sides = []
    for grams in (left, right):
        flat = np.concatenate([np.asarray(g, dtype=np.int64) for g in grams])
        sides.append((flat, np.repeat(np.arange(len(grams)), [len(g) for g in grams])))
    (x, own), (y, other) = sides
    shared = np.intersect1d(x, y) if left is not right else np.unique(x)
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    at_x, at_y = np.searchsorted(shared, x), np.searchsorted(shared, y)
    in_x = (at_x < len(shared)) & (shared[np.minimum(at_x, len(shared) - 1)] == x) if len(shared) else np.zeros(len(x), bool)
    in_y = (at_y < len(shared)) & (shared[np.minimum(at_y, len(shared) - 1)] == y) if len(shared) else np.zeros(len(y), bool)
    order_x, order_y = np.flatnonzero(in_x)[np.argsort(at_x[in_x])], np.flatnonzero(in_y)[np.argsort(at_y[in_y])]
    for low in range(0, len(shared), _FRAGMENT):
        parts = []
        for at, order, owner, rows in ((at_x, order_x, own, len(left)), (at_y, order_y, other, len(right))):
            mine = order[np.searchsorted(at[order], low) : np.searchsorted(at[order], low + _FRAGMENT)]
            part = np.zeros((rows, min(_FRAGMENT, len(shared) - low)), dtype=np.float32)
            part[owner[mine], at[mine] - low] = 1
            parts.append(part)
        total += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return total
