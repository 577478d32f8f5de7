"""Factors of planted groups, tuning, prediction, answers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from followgraph.operators import bounds, evaluation, lookup, model as M, overlap, similarity
from followgraph.operators.evaluation import overlap_share, top_n_error
from followgraph.plans import training
from followgraph.session import written

ARTISTS, FOLLOWERS = 24, 120


def planted():
    random = np.random.default_rng(7)
    inside = np.arange(FOLLOWERS)[:, None] % 2 == np.arange(ARTISTS)[None, :] % 2
    follows = random.random((FOLLOWERS, ARTISTS)) < np.where(inside, 0.6, 0.03)
    return [(f"artist{a:02d}", f"follower{f:03d}") for f, a in zip(*np.nonzero(follows))]


@pytest.fixture(scope="module")
def trained(spark):
    edges = spark.createDataFrame(planted(), "artist_alias STRING, follower_alias STRING")
    artists = edges.select(F.col("artist_alias").alias("sc_alias")).distinct()
    return training.train(edges, artists, edges.select("follower_alias"))


def _matrix(trained):
    items = {r.id: r.features for r in trained.model.itemFactors.collect()}
    users = {r.id: r.features for r in trained.model.userFactors.collect()}
    return np.array([users[i] for i in sorted(users)]), np.array([items[i] for i in sorted(items)])


def test_factors_are_non_negative_and_named(trained):
    rows = trained.factors.collect()
    assert len(rows) == ARTISTS and all(len(r.features) == 5 and min(r.features) >= 0 for r in rows)
    assert {r.id: r.artist_alias for r in rows} == {i + 1: f"artist{i:02d}" for i in range(ARTISTS)}


def test_planted_groups_are_neighbours(spark, trained):
    similar = similarity.top_similar(trained.factors, 5)
    assert similar.where("(id - similar_id) % 2 != 0").count() == 0
    shares = overlap_share(similar.withColumnRenamed("id", "artist_id"), overlap.top_overlap(trained.edges, 5), 5)
    assert shares.agg(F.avg("share")).head()[0] > 2 * 5 / (ARTISTS - 1) * 0.9


def test_loss_falls_as_an_independent_solver_says(trained):
    """Implicit loss sum c (p - x.y)^2 + lambda n |.|^2 of the factors beats the zero model, and a plain
    numpy alternation from the same items lowers it further or keeps it."""
    edges = {(r.follower_id, r.artist_id) for r in trained.edges.collect()}
    preference = np.array([[float((f, a) in edges) for a in range(1, ARTISTS + 1)] for f in range(1, FOLLOWERS + 1)])
    confidence = 1 + preference
    per_user, per_item = preference.sum(1), preference.sum(0)

    def loss(users, items):
        fit = (confidence * (preference - users @ items.T) ** 2).sum()
        return fit + (per_user * (users**2).sum(1)).sum() + (per_item * (items**2).sum(1)).sum()

    users, items = _matrix(trained)
    zero = loss(np.zeros_like(users), np.zeros_like(items))
    assert loss(users, items) < zero
    solved = np.array(
        [
            np.linalg.solve(items.T @ (confidence[u][:, None] * items) + per_user[u] * np.eye(5), items.T @ (confidence[u] * preference[u]))
            for u in range(FOLLOWERS)
        ]
    )
    assert loss(solved, items) <= loss(users, items) + 1e-6


def test_recommendations_are_the_best_products(trained):
    users, items = _matrix(trained)
    scores = np.round(users @ items.T, 12)
    want = {u + 1: sorted(range(1, ARTISTS + 1), key=lambda a: (-scores[u, a - 1], a))[:4] for u in range(FOLLOWERS)}
    got = {}
    for row in M.recommend_artists(trained.model, 4).orderBy("follower_id", "rank").collect():
        got.setdefault(row.follower_id, []).append(row.artist_id)
    assert got == want


def test_recommendations_for_some_followers(spark, trained):
    some = spark.createDataFrame([(3,), (3,), (999,)], "follower_id INT")
    got = M.recommend_artists(trained.model, 4, some).collect()
    assert {r.follower_id for r in got} == {3} and len(got) == 4


def test_predictions_drop_unseen_ids(spark, trained):
    pairs = spark.createDataFrame([(1, 1), (2, 1), (1, 999)], "follower_id INT, artist_id INT")
    got = M.predict(trained.model, pairs).collect()
    assert len(got) == 2 and got[0].prediction >= got[1].prediction


def test_error_of_the_top_n(spark):
    recommended = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.25), (2, 1, 1.0)], "follower_id INT, artist_id INT, prediction DOUBLE")
    edges = spark.createDataFrame([(1, 1), (2, 9)], "follower_id INT, artist_id INT")
    row = top_n_error(recommended, edges).collect()[0]
    assert row.pairs == 3 and row.hit_rate == pytest.approx(1 / 3)
    assert row.rmse == pytest.approx(((0.5**2 + 0.25**2 + 1) / 3) ** 0.5)


def test_split_is_whole_and_disjoint(trained):
    train_part, test_part = M.split(trained.edges)
    assert train_part.count() + test_part.count() == trained.edges.count()
    assert train_part.intersect(test_part).count() == 0 and test_part.count() > 0


def test_grid_search_fits_as_many_settings_at_once_as_occupy_the_cores(spark, trained, monkeypatch):
    used = []

    class Noted(M.CrossValidator):
        def fit(self, ratings):
            used.append(self.getParallelism())

    monkeypatch.setattr(M, "CrossValidator", Noted)
    cores = spark.sparkContext.defaultParallelism
    M.grid_search(trained.edges, numUserBlocks=1, numItemBlocks=1)
    M.grid_search(trained.edges, numUserBlocks=2 * cores, numItemBlocks=1)
    M.grid_search(trained.edges, parallelism=2)
    assert used == [2 * cores, 1, 2]
    assert [M.fits_at_once(blocks, 12) for blocks in (10, 24, 43)] == [3, 1, 1]


def test_grid_search_finds_the_lowest_error(spark, trained):
    search = M.grid_search(trained.edges, ranks=[2, 5], reg_params=[0.1, 1.0], folds=2, maxIter=2)
    results = M.grid_results(search)
    assert len(results) == 4 and all(np.isfinite(r["rmse"]) for r in results)
    best = min(results, key=lambda r: r["rmse"])
    assert M.best_parameters(search) == {"rank": best["rank"], "regParam": best["regParam"]}
    assert search.bestModel.rank == best["rank"]


def test_answers_from_factors(spark, trained, tmp_path):
    artists = trained.factors.select(F.col("artist_alias").alias("sc_alias"), F.upper("artist_alias").alias("artist_name"))
    extra = spark.createDataFrame([("artist00", "A far longer name"), ("unknown", "No factors")], "sc_alias STRING, artist_name STRING")
    meta = artists.where("sc_alias != 'artist05'").unionByName(extra)
    path = str(tmp_path / "lookup")
    lookup.write_lookup(training.answers(trained.factors, meta, 5), path)
    got = lookup.recommend(spark, path, "artist00", 3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert all(int(r.similar_alias[-2:]) % 2 == 0 and r.artist_name == "ARTIST00" for r in got)
    assert got[0].similar_url == "https://soundcloud.com/" + got[0].similar_alias
    assert lookup.recommend(spark, path, "artist05").count() == 0 and lookup.recommend(spark, path, "nobody").count() == 0
    assert spark.read.parquet(path).where("similar_alias = 'artist05'").count() == 0
    plan = lookup.recommend(spark, path, "artist00")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(alias,artist00)" in plan


def test_artist_info_joins_by_the_stored_alias(spark, trained):
    meta = spark.createDataFrame([("artist03", "Three"), ("artist03", "Three"), ("gone", "Gone")], "sc_alias STRING, artist_name STRING")
    rows = lookup.artist_info(trained.factors, meta).collect()
    assert [(r.id, r.artist_name) for r in rows] == [(4, "Three")]


def test_options_are_ordered_by_name(spark):
    rows = spark.createDataFrame([("z", "B"), ("y", "A"), ("a", "B")], "sc_alias STRING, artist_name STRING")
    assert [tuple(r) for r in lookup.artist_options(rows).collect()] == [("y", "A"), ("a", "B"), ("z", "B")]


def test_isolated_artist_does_not_break_answers(spark):
    pairs = planted() + [("lonely", "hermit")]
    edges = spark.createDataFrame(pairs, "artist_alias STRING, follower_alias STRING")
    result = training.train(edges, edges.select(F.col("artist_alias").alias("sc_alias")), edges.select("follower_alias"))
    assert result.factors.count() == ARTISTS + 1
    similar = similarity.top_similar(result.factors, 30)
    assert similar.where("cosine IS NULL OR isnan(cosine)").count() == 0


def test_two_factor_variant(trained):
    model = M.fit(trained.edges, rank=2)
    assert model.rank == 2


def test_written_tables_go_to_the_named_folder(spark):
    table = written(spark.range(3).toDF("id"), "probe")
    assert spark.conf.get("spark.checkpoint.dir") in table.inputFiles()[0]


def test_ranking_metrics_by_hand(spark):
    recommended = [(1, 1, 10), (1, 2, 11), (1, 3, 12), (2, 1, 10), (3, 1, 10), (1, 4, 13)]
    relevant = [(1, 11), (1, 12), (1, 12), (1, 99), (1, 13), (2, 10), (4, 10), (None, 10), (5, None)]
    rows = evaluation.ranking_metrics(
        spark.createDataFrame(recommended, "follower_id int, rank int, artist_id int"),
        spark.createDataFrame(relevant, "follower_id int, artist_id int"),
        3,
    )
    got = {r["follower_id"]: r for r in rows.collect()}
    assert set(got) == {1, 2, 4}
    gain = lambda *ranks: sum(1 / math.log2(r + 1) for r in ranks)
    assert (got[1]["relevant"], got[1]["hits"]) == (4, 2)
    assert got[1]["precision"] == pytest.approx(2 / 3) and got[1]["recall"] == pytest.approx(1 / 2)
    assert got[1]["ndcg"] == pytest.approx(gain(2, 3) / gain(1, 2, 3))
    assert got[1]["average_precision"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got[2]["ndcg"] == got[2]["average_precision"] == got[2]["recall"] == 1 and got[2]["precision"] == pytest.approx(1 / 3)
    assert (got[4]["hits"], got[4]["ndcg"], got[4]["average_precision"]) == (0, 0, 0)
    mean = evaluation.mean_metrics(rows).head()
    assert mean["followers"] == 3 and mean["recall"] == pytest.approx(0.5)
    assert evaluation.mean_metrics(rows.limit(0)).head()["followers"] == 0


def test_ranked_search_prefers_what_ranks_better(spark):
    edges = [(f"a{a}", f"f{f}", a, f, 1) for a in range(12) for f in range(30) if a % 3 == f % 3]
    edges = spark.createDataFrame(edges, "artist_alias string, follower_alias string, artist_id int, follower_id int, count int")
    folds = {r["fold"] for r in M.with_fold(edges, 3).select("fold").distinct().collect()}
    assert folds == {0, 1, 2}
    results = M.ranked_search(edges, 3, folds=2, ranks=(1, 4), reg_params=(0.01,))
    assert sum(r.best for r in results) == 1 and next(r for r in results if r.best).ndcg == max(r.ndcg for r in results)
    assert next(r for r in results if r.best).rank == 4 and max(r.ndcg for r in results) > 0.8


def test_known_artists_are_not_recommended(spark):
    edges = [(a, f, 1) for a in range(20) for f in range(9) if f == 0 and a < 15 or (a + f) % 4 == 0]
    known = spark.createDataFrame(edges, "artist_id int, follower_id int, count int")
    rows = M.recommend_unknown(M.fit(known, rank=3), known, 5).collect()
    assert not {(r["artist_id"], r["follower_id"]) for r in rows} & {(a, f) for a, f, _ in edges}
    lists = {f: sorted(r["rank"] for r in rows if r["follower_id"] == f) for f in range(9)}
    left = len({a for a, _, _ in edges}) - sum(f == 0 for _, f, _ in edges)
    assert lists[0] == list(range(1, min(5, left) + 1)) and all(lists[f] == [1, 2, 3, 4, 5] for f in range(1, 9))


def test_followers_of_many_artists_need_no_longer_lists(spark, monkeypatch):
    asked, plain = [], M.best_products
    monkeypatch.setattr(M, "best_products", lambda users, items, n, **more: (asked.append(n), plain(users, items, n, **more))[1])
    known = spark.createDataFrame([(a, f, 1) for a in range(40) for f in range(6) if f == 0 or a % 6 == f], "artist_id int, follower_id int, count int")
    rows = M.recommend_unknown(M.fit(known, rank=2), known, 5).collect()
    assert asked == [5] and {r["follower_id"] for r in rows} == {1, 2, 3, 4, 5}


def test_large_tables_are_recommended_from_clusters(spark, monkeypatch):
    edges = [(a, f, 1) for a in range(60) for f in range(150) if (a * 7 + f * 3) % 11 < 3 or (f == 0 and a < 50)]
    known = spark.createDataFrame(edges, "artist_id int, follower_id int, count int")
    fitted = M.fit(known, rank=3)
    listed = lambda df: sorted((r.follower_id, r["rank"], r.artist_id, round(r.prediction, 9)) for r in df.collect())
    want = listed(M.recommend_artists(fitted, 4)), listed(M.recommend_unknown(fitted, known, 4))
    monkeypatch.setattr(bounds, "LARGE", 1)
    monkeypatch.setattr(M, "best_products", None)  # not asked
    assert (listed(M.recommend_artists(fitted, 4)), listed(M.recommend_unknown(fitted, known, 4))) == want


def test_long_trainings_keep_one_iteration(spark, monkeypatch):
    known = spark.createDataFrame([(a, f, 1) for a in range(30) for f in range(40) if (a + f) % 5 < 2], "artist_id int, follower_id int, count int")
    factors = lambda fitted: sorted((r.id, tuple(r.features)) for r in fitted.itemFactors.collect())
    blocks = {"numUserBlocks": 3, "numItemBlocks": 3}
    want = factors(M.fit(known, **blocks))
    asked, plain = [], M.als
    monkeypatch.setattr(M, "als", lambda **settings: (asked.append(settings), plain(**settings))[1])
    monkeypatch.setattr(M, "_EDGES_PER_BLOCK", 50)
    monkeypatch.setattr(M, "_SWEEP_SECONDS", 0.05)
    assert factors(M.fit(known, **blocks)) == want and asked[0]["checkpointInterval"] == 1
