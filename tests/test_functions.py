"""Column expressions on literal rows."""

import pytest
from pyspark.sql import functions as F

from followgraph.functions import links, names, vectors


def apply(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, v {kind}")
    return [r.out for r in rows.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_number_suffixes_are_stripped(spark):
    given = ["Abc (3)", "Abc (12)", "Abc (12) (3)", "Abc (3", "(3)", " (3)", "A (3)", "A (1x", "Various (2)", None]
    want = ["Abc", "Abc", "Abc", "Abc (3", "(3)", " (3)", "A", "A", "Various", None]
    assert apply(spark, given, names.strip_number_suffix) == want


def test_suffix_must_end_the_name(spark):
    given = ["A (3)\n", "A\nB (3)", "Abc (123)", "é (4)"]
    assert apply(spark, given, names.strip_number_suffix) == ["A (3)\n", "A\nB", "Abc (123)", "é"]


def test_flags_equal_to_zero(spark):
    given = ["0", "1", "0.0", " 0 ", "", "duplicate_flag", None]
    kept = [v for v, ok in zip(given, apply(spark, given, names.flag_is_zero)) if ok]
    assert kept == ["0", "0.0", " 0 "]


def test_first_digits(spark):
    assert apply(spark, ["Disc (34) 5", "none", None], names.first_digits) == ["34", None, None]


def test_search_phrase_joins_words(spark):
    given = ["  two  words\tand\u00a0more ", "one"]
    assert apply(spark, given, names.search_phrase) == ["two+words+and+more+soundcloud+page", "one+soundcloud+page"]


def test_invalid_utf8_is_dropped(spark):
    given = [b"caf\xc3\xa9", b"a\xffb\xc3", "a\ufffdb".encode() + b"\xff", "kept \ufffd mark".encode(), None]
    got = apply(spark, [None if g is None else bytearray(g) for g in given], names.drop_invalid_utf8, "binary")
    assert got == ["café", "ab", "a\ufffdb", "kept \ufffd mark", None]


def test_alias_needs_the_exact_address_form(spark):
    given = [
        "https://soundcloud.com/name",
        "https://soundcloud.com/name/",
        "http://soundcloud.com/name",
        "https://elsewhere.com/name",
        "nothing",
        None,
    ]
    missing = "No Soundcloud Found"
    assert apply(spark, given, links.alias_from_url) == ["name", missing, missing, missing, missing, None]


def test_addresses(spark):
    assert apply(spark, ["a"], links.profile_url) == ["https://soundcloud.com/a"]
    assert apply(spark, ["a"], links.followers_url) == ["https://soundcloud.com/a/followers"]
    given = ["https://api.soundcloud.com/users/1?cursor=2", "https://else/users", None]
    assert apply(spark, given, links.page_cursor) == ["/users/1?cursor=2", None, None]


def test_features_are_parsed(spark):
    assert apply(spark, ["[0.5, 1, -2e-3]", "[]", "no list", None], vectors.parse_features) == [
        [0.5, 1.0, -0.002],
        [],
        None,
        None,
    ]


@pytest.mark.parametrize(
    "vector, complete, cosine",
    [([1.0, 0.0], True, True), ([0.0, 0.0], True, False), ([], False, False), ([1.0, None], False, False)],
)
def test_vector_checks(spark, vector, complete, cosine):
    assert apply(spark, [vector], vectors.is_complete, "array<double>") == [complete]
    assert apply(spark, [vector], vectors.has_cosine, "array<double>") == [cosine]


def test_missing_vector_has_no_cosine(spark):
    assert apply(spark, [None, [float("nan")]], vectors.has_cosine, "array<double>") == [False, False]
