"""End-to-end jobs on small inputs."""

from followgraph.plans import roster_build, training


def test_roster_from_pages(spark):
    lists = spark.createDataFrame([('<a title="A">Abc</a><a title="B">Def (2)</a><a href="/">skip</a><a title="E"></a>',)], "html STRING")
    results = spark.createDataFrame(
        [('<span title="Abc (3)" itemprop="name"></span><span title="Various" itemprop="name"></span><span title="New One" itemprop="name"></span>',)],
        "html STRING",
    )
    got = sorted(map(tuple, roster_build.roster_from_pages(lists, results).select("artist_name", "source_rank", "search_phrase").collect()))
    suffix = "+soundcloud+page"
    assert got == [("Abc", 1, "Abc" + suffix), ("Def", 1, "Def" + suffix), ("New One", 2, "New+One" + suffix)]


def test_resolved_and_overridden_aliases(spark):
    found = spark.createDataFrame(
        [("A", "https://soundcloud.com/a"), ("B", "https://elsewhere.com/b"), ("C", "https://soundcloud.com/x"), ("D", None)],
        "artist_name STRING, result_url STRING",
    )
    pairs = spark.createDataFrame([("D", "dee"), ("A", "aa")], "artist_name STRING, sc_alias STRING")
    got = sorted(map(tuple, roster_build.resolve_aliases(found, pairs).select("artist_name", "sc_alias").collect()))
    assert got == [("A", "aa"), ("D", "dee")]


COLUMNS = "artist_name STRING, sc_alias STRING, page_name STRING, source_rank INT, plan STRING, followers_count INT"
ROWS = [
    ("One", "one", "one", 1, "Free", 900),
    ("DJ One", "one", "one", 1, "Pro", 1),
    ("Small", "small", "small", 1, "Free", 10),
    ("Paid", "paid", "paid", 2, "Pro Plus", 10),
]


def test_harvest_list_by_closest_name(spark):
    got = roster_build.harvest_list(spark.createDataFrame(ROWS, COLUMNS)).collect()
    assert [r.artist_name for r in got] == ["Paid", "One"]


def test_harvest_list_by_review(spark):
    rows = spark.createDataFrame(ROWS, COLUMNS)
    review = spark.createDataFrame([(*ROWS[0], None), (*ROWS[1], "x")], COLUMNS + ", review STRING")
    assert [r.artist_name for r in roster_build.harvest_list(rows, review).collect()] == ["DJ One", "Paid"]


def test_eligible_artists(spark):
    rows = spark.createDataFrame(
        [("A", "a", "0"), ("A", "a", "0"), ("B", "b", "1"), ("Daft Punk", "d", "0"), ("C", "c", "0.0"), (None, "n", "0")],
        "artist_name STRING, sc_alias STRING, duplicate_flag STRING",
    )
    assert sorted(r.artist_name for r in training.eligible_artists(rows).collect()) == ["A", "C"]
