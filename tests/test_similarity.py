"""Exact nearest items and overlaps against brute force, with hot groups and tiny tiles."""

import collections
import itertools

import numpy as np
import pyarrow as pa
import pytest

from followgraph.operators import overlap, similarity, tiles
from followgraph.operators.evaluation import overlap_share


def _items(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in vectors.items()], "id INT, features ARRAY<DOUBLE>")


def _brute_force(vectors, n):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors.items() if v is not None and np.any(v)}
    found = {}
    for a in unit:
        scores = sorted((-round(float(unit[a] @ unit[b]), 10), b) for b in unit if b != a)[:n]
        found[a] = [b for _, b in scores]
    return found


def _found(df, key="id", other="similar_id"):
    found = collections.defaultdict(list)
    for row in df.orderBy(key, "rank").collect():
        found[row[key]].append(row[other])
        assert row["rank"] == len(found[row[key]])
    return dict(found)


@pytest.mark.parametrize("block_rows, block_columns", [(1000, 1000), (7, 11), (40, 5)])
def test_nearest_items_equal_brute_force(spark, block_rows, block_columns):
    random = np.random.default_rng(5)
    vectors = {int(i): random.integers(0, 5, 4).astype(float).tolist() for i in random.permutation(90)}
    for i in range(0, 90, 3):
        vectors[i] = [1.0, 2.0, 0.0, 3.0]  # a third of the items are copies of one
    found = similarity.top_similar(_items(spark, vectors), 6, block_rows=block_rows, block_columns=block_columns)
    assert _found(found) == _brute_force(vectors, 6)
    assert found.where("cosine > 1 OR cosine < -1").count() == 0


def test_special_vectors(spark):
    vectors = {1: [1.0, 0.0], 2: [2.0, 0.0], 3: [0.0, 0.0], 4: [-1.0, 0.5], 5: None, 6: [1.0, float("nan")], 7: [1e-30, 1e-30]}
    got = similarity.top_similar(_items(spark, vectors), 30)
    assert _found(got) == {1: [2, 7, 4], 2: [1, 7, 4], 4: [7, 1, 2], 7: [1, 2, 4]}
    score = {(r.id, r.similar_id): r.cosine for r in got.collect()}
    assert score[1, 2] == 1.0 and score[1, 7] == score[7, 1] == pytest.approx(0.5**0.5)


def test_nothing_to_compare(spark):
    assert similarity.top_similar(_items(spark, {1: [0.0]})).count() == 0
    assert similarity.top_similar(_items(spark, {1: [1.0]})).count() == 0


def test_products_without_scaling_keep_zero_vectors(spark):
    rows, columns = _items(spark, {1: [1.0, 2.0], 2: [0.0, 0.0]}), _items(spark, {1: [1.0, 0.0], 5: [0.0, 1.0], 9: [0.0, 2.0]})
    got = tiles.best_products(rows, columns, 2)
    assert _found(got, "row_id", "column_id") == {1: [9, 5], 2: [1, 5]}


def test_factor_dominance(spark):
    items = _items(spark, {1: [0.5, 0.0], 2: [0.5, 3.0], 3: [0.9, 1.0]})
    want = [(0, 1, 3), (0, 2, 1), (0, 3, 2), (1, 1, 2), (1, 2, 3), (1, 3, 1)]
    got = similarity.factor_dominance(items).select("factor", "rank", "id")
    assert sorted(map(tuple, got.collect())) == want
    got = similarity.factor_dominance(items, 2).select("factor", "rank", "id")
    assert sorted(map(tuple, got.collect())) == [w for w in want if w[1] <= 2]


def _skewed_edges():
    random = np.random.default_rng(11)
    edges = {(int(a), int(f)) for a, f in zip(random.integers(0, 60, 500), random.integers(100, 190, 500))}
    edges |= {(a, 7) for a in range(60)}  # a follower of every artist
    edges |= {(13, f) for f in range(100, 400)}  # an artist with a third of all edges
    return sorted(edges)


def _overlaps(edges):
    followed = collections.defaultdict(set)
    for artist, follower in edges:
        followed[follower].add(artist)
    common = collections.Counter()
    for artists in followed.values():
        common.update(itertools.combinations(sorted(artists), 2))
    return common


@pytest.mark.parametrize(
    "block_artists, shard_rows, tail, light",
    [(4096, 4_000_000, 8, 32), (9, 4_000_000, 0, 32), (9, 60, 0, 32), (100, 50, 8, 32), (5, 4_000_000, 12, 32), (5, 60, 12, 3), (7, 4_000_000, 10**6, 5)],
)
def test_common_followers_equal_brute_force(spark, monkeypatch, block_artists, shard_rows, tail, light):
    monkeypatch.setattr(overlap, "_TAIL_FOLLOWERS", tail)
    monkeypatch.setattr(overlap, "_LIGHT", light)
    edges = _skewed_edges()
    table = spark.createDataFrame(edges, "artist_id INT, follower_id INT")
    common = _overlaps(edges)
    got = overlap.common_followers(table, block_artists=block_artists, shard_rows=shard_rows)
    assert {(r.artist, r.other): r.common for r in got.collect()} == dict(common)
    assert got.count() == len(common)

    want = collections.defaultdict(list)
    for (a, b), n in common.items():
        want[a].append((-n, b))
        want[b].append((-n, a))
    want = {a: [b for _, b in sorted(found)[:4]] for a, found in want.items()}
    best = overlap.top_overlap(table, 4, block_artists=block_artists, shard_rows=shard_rows)
    assert _found(best, "artist", "other") == want


def test_sparse_and_dense_products_agree(monkeypatch):
    followed = collections.defaultdict(list)
    for artist, follower in _skewed_edges():
        followed[follower].append(artist)
    rows = list(followed.values())
    batch = pa.record_batch(
        {
            "low_artists": rows,
            "high_artists": rows,
            "low": [0] * len(rows),
            "high": [0] * len(rows),
            "shards": [1] * len(rows),
        }
    )
    for share, at_once, cells in ((10**9, 4, 64), (0, 4_000_000, 200), (50, 100, 1000)):
        monkeypatch.setattr(overlap, "_DENSE_SHARE", share)
        monkeypatch.setattr(overlap, "_PAIRS_AT_ONCE", at_once)
        monkeypatch.setattr(overlap, "_DENSE_CELLS", cells)
        batches = [batch.slice(0, 3), batch.slice(3)]
        parts = [p.to_pydict() for p in overlap._tile_function(None, False)(iter(batches))]
        counts = {(a, b): n for p in parts for a, b, n in zip(p["artist"], p["other"], p["common"])}
        assert counts == dict(_overlaps(_skewed_edges()))


def test_no_common_followers_and_no_edges(spark):
    table = spark.createDataFrame([(1, 1), (2, 2)], "artist_id INT, follower_id INT")
    assert overlap.common_followers(table).count() == 0
    assert overlap.top_overlap(table.limit(0), 3).count() == 0


def test_overlap_share(spark):
    similar = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (2, 3, 4)], "artist_id INT, rank INT, similar_id INT")
    truth = spark.createDataFrame([(1, 1, 3, 9), (1, 2, 2, 8), (2, 1, 4, 9), (2, 2, 5, 8)], "artist INT, rank INT, other INT, common INT")
    got = {r.artist_id: (r.hits, r.share) for r in overlap_share(similar, truth, 2).collect()}
    assert got == {1: (2, 1.0), 2: (0, 0.0)}


def test_columns_go_to_few_blocks():
    size = tiles.rows_per_block(1_200_000, 30, 12)
    assert -(-1_200_000 // size) <= 24  # 480 blocks of rows and 60 of columns before
    assert tiles.rows_per_block(1_200_000, 4_106, 12) * 4_106 <= 4_000_000  # answers that a task holds
    assert tiles.rows_per_block(100, 30, 12) == 2_500 and tiles.rows_per_block(100, 30, 12, most=7) == 7


@pytest.mark.parametrize("unit", [True, False])
def test_copies_are_settled_by_id_across_packs(spark, monkeypatch, unit):
    monkeypatch.setattr(tiles, "_SCORE_CELLS", 64)
    random = np.random.default_rng(3)
    kinds = [[1.0, 2.0, 0.0], [2.0, 4.0, 0.0], [0.0, 0.0, 0.0], [0.3, 0.1, 0.7], [1e-200, 0.0, 3e-200]]
    items = _items(spark, {int(k): kinds[k % 5] for k in random.permutation(200)}).repartition(4)
    got = _found(tiles.best_products(items, items, 3, unit=unit, skip_same_id=True, block_rows=40, block_columns=16), "row_id", "column_id")
    if unit:
        assert got[0] == [1, 5, 6] and got[1] == [0, 5, 6] and got[3] == [8, 13, 18] and 2 not in got
    else:
        assert got[0] == [1, 6, 11] and got[1] == [6, 11, 16] and got[2] == [0, 1, 3]


def test_a_sparse_graph_needs_no_tiles(spark, monkeypatch):
    random = np.random.default_rng(2)
    edges = sorted({(int(a), int(f)) for a, f in zip(random.integers(-3, 2_000, 6_000), random.integers(0, 300, 6_000))})
    monkeypatch.setattr(overlap, "_tile_function", lambda *_: pytest.fail("a tile"))
    monkeypatch.setattr(overlap, "_PAIRS_AT_ONCE", 5_000)
    monkeypatch.setattr(overlap, "_LIGHT", 6)
    monkeypatch.setattr(overlap, "_TAIL_FOLLOWERS", 1)
    monkeypatch.setattr(overlap, "_TASK_PAIRS", 40_000)
    table = spark.createDataFrame([(a, 1 << 40 | f) for a, f in edges], "artist_id BIGINT, follower_id BIGINT")
    got = overlap.common_followers(table, block_artists=100)
    assert {(r.artist, r.other): r.common for r in got.collect()} == dict(_overlaps(edges))


@pytest.mark.parametrize("unit", [True, False])
def test_pairs_that_are_left_out_are_no_answers(spark, monkeypatch, unit):
    monkeypatch.setattr(tiles, "_SCORE_CELLS", 64)
    random = np.random.default_rng(4)
    vectors = {k: [float(x) for x in random.normal(size=3)] for k in range(90)}
    out = {(int(r), int(c)) for r, c in random.integers(0, 95, (2_000, 2))} | {(5, c) for c in range(90)}
    pairs = spark.createDataFrame([*out, (None, 1), (1, None)], "row_id bigint, column_id bigint").repartition(3)
    items = _items(spark, vectors).repartition(4)
    got = tiles.best_products(items, items, 4, unit=unit, skip_same_id=True, block_rows=20, block_columns=16, left_out=pairs)
    want = {}
    for a, x in vectors.items():
        length = lambda v: np.sqrt(np.dot(v, v)) if unit else 1.0
        scores = sorted((-round(float(np.dot(x, y) / length(x) / length(y)), 9), b) for b, y in vectors.items() if b != a and (a, b) not in out)
        if scores:
            want[a] = [b for _, b in scores[:4]]
    assert 5 not in want and _found(got, "row_id", "column_id") == want


def test_rows_with_the_same_id_are_ranked_as_one(spark):
    rows = _items(spark, {1: [1.0, 0.0], 2: [0.0, 1.0]}).unionByName(_items(spark, {1: [0.0, 5.0]}))
    columns = _items(spark, {1: [1.0, 1.0], 2: [3.0, 0.0], 3: [0.0, 2.0], 4: [4.0, 0.0]})
    got = sorted((r.row_id, r["rank"], r.column_id, round(r.score, 9)) for r in tiles.best_products(rows, columns, 3).collect())
    assert got == [(1, 1, 3, 10.0), (1, 2, 1, 5.0), (1, 3, 4, 4.0), (2, 1, 3, 2.0), (2, 2, 1, 1.0), (2, 3, 2, 0.0)]


def test_answers_are_not_shuffled_for_their_ranks(spark):
    items = _items(spark, {k: [1.0, float(k)] for k in range(30)})
    plan = tiles.best_products(items, items, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
