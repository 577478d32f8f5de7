"""Edges, ids, activity, documents."""

import datetime

from pyspark.sql import functions as F

from followgraph import schemas
from followgraph.operators import activity, edges as E, nesting


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "artist_alias STRING, follower_alias STRING")


def test_training_edges_need_artist_and_profile(spark):
    edges = E.distinct_edges(_edges(spark, [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"), ("c", "x"), ("a", "nobody"), (None, "x"), ("a", None)]))
    artists = E.artist_ids(spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "sc_alias STRING"))
    followers = E.follower_ids(spark.createDataFrame([("y",), ("x",), (None,)], "follower_alias STRING"))
    got = sorted(map(tuple, E.training_edges(edges, artists, followers).collect()))
    assert got == [(1, 1, "a", "x", 1), (1, 2, "a", "y", 1), (2, 1, "b", "x", 1)]
    lost = E.dropped_edges(edges, artists, followers).collect()[0]
    assert (lost.without_artist, lost.without_profile) == (1, 1)


def test_latest_profile_per_follower(spark):
    rows = spark.createDataFrame(
        [("a", "x", "2016/01/02", 5), ("b", "x", "2016/03/01", 7), ("c", "x", None, 9), ("a", "y", None, 1)],
        "artist_alias STRING, follower_alias STRING, last_modified STRING, track_count INT",
    )
    got = sorted(map(tuple, E.follower_profile(rows).select("follower_alias", "track_count").collect()))
    assert got == [("x", 7), ("y", 1)]


def test_activity(spark):
    edges = _edges(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("a", "z")])
    assert [tuple(r) for r in activity.follower_activity(edges).collect()] == [("x", 3), ("y", 1), ("z", 1)]
    row = activity.activity_thresholds(edges, thresholds=[1, 2, 3]).collect()[0]
    assert row.asDict() == {"edges": 5, "followers": 3, "artists": 3, "over_1": 1, "over_2": 1, "over_3": 0, "density": 5 / 9}
    empty = activity.activity_thresholds(edges.limit(0)).collect()[0]
    assert (empty.edges, empty.followers, empty.density) == (0, 0, None)


def test_popularity_keeps_artists_without_followers(spark):
    artists = spark.createDataFrame([("a", 4), ("b", 0), ("q", 10)], "artist_alias STRING, followers_count INT")
    got = activity.artist_popularity(_edges(spark, [("a", "x"), ("a", "y"), ("b", "x")]), artists).collect()
    assert [(r.artist_alias, r.stored_followers, r.completeness) for r in got] == [("q", 0, 0.0), ("b", 1, None), ("a", 2, 0.5)]


def test_last_harvest_report_counts(spark):
    t = datetime.datetime
    log = spark.createDataFrame(
        [(1000, 3000, "a", 1, 2, t(2016, 1, 1), None), (1500, 3000, "a", 1, 2, t(2016, 1, 2), "boom"), (7, 0, "b", 2, 2, t(2016, 1, 1), None)],
        schemas.HARVEST_LOG,
    )
    got = {r.alias: (r.added, r.ratio, r.error, r.failed, r.reports) for r in activity.harvest_completeness(log).collect()}
    assert got == {"a": (1500, 0.5, "boom", True, 2), "b": (7, None, None, False, 1)}


def test_flatten_reverses_nest_with_a_hot_key(spark):
    rows = spark.range(900).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("alias"),
        F.format_string("f%05d", "id").alias("permalink"),
        F.col("id").alias("track_count"),
    )
    nested = nesting.nest(rows, "alias", ["permalink"], ["permalink", "track_count"], chunk_rows=16)
    assert nested.agg(F.max(F.size("followers"))).head()[0] == 16
    assert nested.where("alias = 'hot'").count() == 19
    flat = nesting.flatten(nested)
    back = flat.select("alias", "permalink", "track_count")
    assert back.exceptAll(rows).count() == 0 and rows.exceptAll(back).count() == 0
    hot = flat.where("alias = 'hot'").orderBy("artist_follower_num").collect()
    assert [r.artist_follower_num for r in hot] == list(range(1, 301))
    assert [r.permalink for r in hot] == sorted(r.permalink for r in hot)
    numbers = {r.alias: r.artist_num for r in flat.select("alias", "artist_num").distinct().collect()}
    assert sorted(numbers, key=numbers.get) == sorted(numbers) and sorted(numbers.values()) == list(range(1, len(numbers) + 1))


def _documents(spark):
    follower = {f: None for f in schemas.FOLLOWER.fieldNames()}
    document = {f: None for f in schemas.DOCUMENT.fieldNames()}
    rows = [
        {**document, "alias": "a", "followers": [{**follower, "permalink": "x", "track_count": 3}, {**follower, "permalink": None}]},
        {**document, "alias": "b", "followers": []},
        {**document, "alias": "c", "followers": None},
        {**document, "alias": "d", "followers": [{**follower, "permalink": "x"}]},
    ]
    return spark.createDataFrame(rows, schemas.DOCUMENT)


def test_documents_without_followers_and_broken_followers(spark):
    edges, profiles = nesting.flatten_documents(_documents(spark))
    got = sorted(map(tuple, edges.collect()), key=str)
    assert got == [
        ("follower has no alias", 1, 2, "a", None),
        ("no exception", 1, 1, "a", "x"),
        ("no exception", 4, 1, "d", "x"),
    ]
    assert profiles.columns == schemas.PROFILE.fieldNames()
    assert profiles.where("follower_alias = 'x' AND artist_alias = 'a'").head().track_count == 3


def test_built_documents_keep_artists_without_followers(spark):
    meta = spark.createDataFrame([("a",), ("b",)], "alias STRING")
    for f in schemas.DOCUMENT.fields[:11]:
        if f.name != "alias":
            meta = meta.withColumn(f.name, F.lit(None).cast(f.dataType))
    followers = spark.createDataFrame([("a", "y"), ("a", "x")], "alias STRING, permalink STRING")
    for f in schemas.FOLLOWER.fields:
        if f.name != "permalink":
            followers = followers.withColumn(f.name, F.lit(None).cast(f.dataType))
    got = {r.alias: r for r in nesting.build_documents(meta, followers).collect()}
    assert [f.permalink for f in got["a"].followers] == ["x", "y"] and got["b"].followers == []
    assert got["a"].date_time is not None
