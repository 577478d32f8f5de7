"""Rosters: union, cleaning, duplicates, legitimacy."""

from pyspark.sql import functions as F

from followgraph.operators import roster as R


def _roster(spark, names, rank):
    return spark.createDataFrame([(n, rank) for n in names], "artist_name STRING, source_rank INT")


def _pairs(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_cleaned_names_are_denied_and_deduplicated(spark):
    got = R.clean_roster(
        _roster(spark, ["Abc", "Def (2)", None], 1), _roster(spark, ["Abc (3)", "Various (2)", "Various Artists", "New (11)"], 2)
    )
    assert _pairs(got.select("artist_name", "source_rank")) == [("Abc", 1), ("Def", 1), ("New", 2)]


def test_cleaning_last_lets_names_come_back(spark):
    got = R.clean_roster(_roster(spark, ["Abc", "Abc (3)", "Various (2)", "Various"], 1), clean_last=True)
    assert sorted(r.artist_name for r in got.collect()) == ["Abc", "Abc", "Various"]


def test_union_fills_missing_columns(spark):
    a, b = spark.createDataFrame([(1, "x")], "i INT, a STRING"), spark.createDataFrame([(2, "y")], "i INT, b STRING")
    assert _pairs(R.union_rosters(a, b).select("i", "a", "b")) == [(1, "x", None), (2, None, "y")]


def test_legitimate_needs_plan_or_followers(spark):
    rows = spark.createDataFrame(
        [("a", "Pro", 1), ("b", "Pro Plus", None), ("c", "Free", 500), ("d", "Free", 499), ("e", None, 600), ("f", None, None), ("g", "Free", None)],
        "n STRING, plan STRING, followers_count INT",
    )
    assert sorted(r.n for r in R.legitimate(rows).collect()) == ["a", "b", "c", "e"]


def test_flags(spark):
    rows = spark.createDataFrame([("a", "0"), ("b", "1"), ("c", "?"), ("d", None), ("e", "0.0")], "n STRING, duplicate_flag STRING")
    assert sorted(r.n for r in R.not_flagged(rows).collect()) == ["a", "e"]
    assert [r.n for r in R.unreadable_flags(rows).collect()] == ["c"]


def test_duplicate_lists(spark):
    rows = spark.createDataFrame(
        [("A", "x"), ("B", "x"), ("A", "x"), ("C", "y"), ("D", None), ("E", None)], "artist_name STRING, sc_alias STRING"
    )
    duplicates = R.duplicate_aliases(rows).where("sc_alias IS NOT NULL")
    assert _pairs(duplicates) == [("x", 2)]
    assert R.with_duplicate_count(rows, duplicates).where("count IS NULL").count() == 3
    assert sorted(r.artist_name for r in R.rows_to_review(rows, duplicates).collect()) == ["A", "A", "B"]
    assert sorted(r.artist_name for r in R.unique_rows(rows, duplicates).collect()) == ["C", "D", "E"]


def test_closest_name_wins_then_source_then_name(spark):
    rows = spark.createDataFrame(
        [
            ("DJ One", "one", "one", 2), ("One", "one", "one", 9),
            ("abx", "two", "abc", 2), ("aby", "two", "abc", 1),
            ("xb", "three", "ab", 1), ("ax", "three", "ab", 1),
            ("n2", "four", None, 1), ("n1", "four", None, 1),
        ],
        "artist_name STRING, sc_alias STRING, page_name STRING, source_rank INT",
    )
    got = {r.sc_alias: r.artist_name for r in R.resolve_duplicates(rows).collect()}
    assert got == {"one": "One", "two": "aby", "three": "ax", "four": "n1"}


def test_hot_alias_is_cut_before_the_shuffle(spark):
    rows = spark.range(9).select(
        (F.col("id") % 2).alias("sc_alias"), F.col("id").cast("string").alias("artist_name"), F.lit("p").alias("page_name"), F.lit(1).alias("source_rank")
    )
    plan = R.resolve_duplicates(rows)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_overrides_replace_resolved_aliases(spark):
    rows = spark.createDataFrame([("A", "a"), ("B", None), ("C", "c")], "artist_name STRING, sc_alias STRING")
    pairs = spark.createDataFrame([("A", "z"), ("B", "z"), ("B", "z"), ("B", "zz")], "artist_name STRING, sc_alias STRING")
    assert _pairs(R.override_aliases(rows, pairs)) == [("A", "z"), ("B", "z"), ("C", "c")]


def test_sentinels_and_reviews(spark):
    rows = spark.createDataFrame([("a", "x"), ("x", None), ("No Soundcloud Found", "x"), (None, "x")], "sc_alias STRING, review STRING")
    assert [r.sc_alias for r in R.has_alias(rows).collect()] == ["a"]
    assert R.reviewed(rows).count() == 3
