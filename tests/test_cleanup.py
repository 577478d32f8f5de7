"""Row ranges by counting, documents with broken elements, harvests as they come in, sketches."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from followgraph import schemas
from followgraph.operators import activity, selection
from followgraph.operators.selection import Key, select_range
from followgraph.sources import tables, tolerant
from followgraph.streaming import harvest

# --- row ranges ----------------------------------------------------------------------------------


def ordered(rows, order):
    """Rows in the order, nulls first when ascending and last when descending."""
    for name, ascending in reversed(order):
        rows = sorted(rows, key=lambda r: (r[name] is not None, r[name] if r[name] is not None else 0), reverse=not ascending)
    return rows


@pytest.mark.parametrize("order", [[("a", True), ("b", True), ("c", True)], [("b", False), ("a", True), ("c", True)], [("a", False), ("c", False)]])
@pytest.mark.parametrize("start, stop", [(0, 5), (6, 61), (390, 500), (399, 400), (400, 410), (9, 9), (0, 400)])
def test_ranges_equal_a_sort(spark, monkeypatch, order, start, stop):
    monkeypatch.setattr(selection, "_FEW", 20)
    rng = random.Random(1)
    rows = [{"a": rng.choice([None, 1, 2, 3]), "b": rng.choice([None, "x", "é", "z", ""]), "c": k, "position": "old"} for k in range(400)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(r["a"], r["b"], r["c"]) for r in rows], "a int, b string, c bigint").repartition(5).cache()
    got = {r["position"]: (r["a"], r["b"], r["c"]) for r in select_range(table, [Key(n, up) for n, up in order], start, stop).collect()}
    want = ordered([{k: r[k] for k in "abc"} for r in rows], order)[start:stop]
    assert sorted(got) == list(range(start, min(stop, 400))) if start < stop else not got
    for k, r in enumerate(want):
        assert all(got[start + k]["abc".index(n)] == r[n] for n, _ in order)
    assert len(set(got.values())) == len(got)


def test_a_range_within_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(selection, "_FEW", 10)
    table = spark.range(300).select(F.lit(7).alias("k"), "id").repartition(4).cache()
    got = select_range(table, [Key("k")], 100, 130)
    assert sorted(r["position"] for r in got.collect()) == list(range(100, 130))


def test_no_full_width_write(spark, tmp_path, monkeypatch):
    written_rows = []
    plain = selection.ordered_positions
    monkeypatch.setattr(selection, "ordered_positions", lambda df, *a, **k: (written_rows.append(df.count()), plain(df, *a, **k))[1])
    monkeypatch.setattr(selection, "_FEW", 100)
    spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k")).write.parquet(str(tmp_path / "t"))
    got = select_range(spark.read.parquet(str(tmp_path / "t")), [Key("k", False)], 5000, 5010)
    assert got.count() == 10 and written_rows[0] < 1000


# --- broken documents ----------------------------------------------------------------------------


def test_broken_elements_leave_the_rest(spark):
    good = {"permalink": "a", "track_count": 3, "city": None, "extra": [1]}
    elements = [good, 5, "x", None, [good], {"city": "y"}, {"permalink": None}, {"permalink": 7}, {"permalink": "b", "likes_count": "1"}, {"permalink": "c", "likes_count": 1.5}, {"permalink": ""}]
    documents = [{"alias": "doc", "followers": elements}, {"alias": "none"}, {"alias": "null", "followers": None}, {"alias": "empty", "followers": []}, {"alias": "number", "followers": 3}]
    lines = [json.dumps(d) for d in documents] + ["{", "", None, "[1]", json.dumps({"followers": [good]})]
    sound, broken = tolerant.followers_of(spark.createDataFrame([(x, "c") for x in lines], "line string, alias string"))
    got = sorted(((r["alias"] or "", r["position"], r["follower"]["permalink"], r["follower"]["track_count"]) for r in sound.collect()))
    assert got == [("", 0, "a", 3), ("doc", 0, "a", 3), ("doc", 10, "", None)]
    reasons = {r["position"]: r["reason"] for r in broken.where("alias = 'doc'").collect()}
    wrong = "likes_count is no number"
    assert reasons == {
        **dict.fromkeys((1, 2, 3, 4), tolerant.NO_OBJECT), **dict.fromkeys((5, 6, 7), tolerant.NO_ALIAS), 8: wrong, 9: wrong
    }
    rest = sorted((r["alias"] or "", r["text"] or "", r["reason"]) for r in broken.where("position is null").collect())
    assert rest == sorted([("number", lines[4], tolerant.NO_LIST), *[("", x or "", tolerant.NO_JSON) for x in ("{", "", None, "[1]")]])
    assert sound.schema["follower"].dataType.fieldNames() == schemas.FOLLOWER.fieldNames()
    none = spark.createDataFrame([], "line string")
    assert [d.count() for d in tolerant.followers_of(none)] == [0, 0]


# --- harvests ------------------------------------------------------------------------------------


def log_of(spark, path, rows):
    start = dt.datetime(2024, 1, 1)
    rows = [(added, 100, alias, 1, 1, start + dt.timedelta(minutes=m), error) for alias, m, added, error in rows]
    tables.append_harvest_log(spark.createDataFrame(rows, schemas.HARVEST_LOG).coalesce(1), path)


def test_state_equals_the_whole_log(spark, tmp_path):
    path, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    slices = [
        [("a", 1, 10, None), ("b", 2, 5, "broken"), ("a", 3, 20, None)],
        [("a", 2, 99, "late"), ("c", 4, None, None), ("b", 5, 7, None)],
        [("a", 3, 30, "same time, more"), ("c", 4, 1, None)],
    ]
    for rows in slices:
        log_of(spark, path, rows)
        progress = harvest.follow_harvests(harvest.log_stream(spark, path, files_per_batch=1), "30 days")
        harvest.write_progress(progress, table, state).awaitTermination()
    columns = ["alias", "logged_at", "reports", "added", "expected", "ratio", "error", "failed"]
    got = sorted(map(tuple, harvest.harvest_state(spark, table).select(*columns).collect()))
    want = sorted(map(tuple, activity.harvest_completeness(tables.read_harvest_log(spark, path)).select(*columns).collect()))
    assert got == want and len(got) == 3
    assert harvest.harvest_state(spark, table).where("stalled").count() == 0


def test_a_harvest_without_reports_stalls(spark, tmp_path):
    path, table, state = (str(tmp_path / n) for n in ("log", "table", "state"))
    for rows in ([("a", 0, 10, None), ("b", 0, 5, None)], [("b", 500, 6, None)], [("b", 501, 7, None)]):
        log_of(spark, path, rows)
        progress = harvest.follow_harvests(harvest.log_stream(spark, path), "1 hour")
        harvest.write_progress(progress, table, state).awaitTermination()
    got = {r["alias"]: (r["stalled"], r["reports"], r["added"]) for r in harvest.harvest_state(spark, table).collect()}
    assert got == {"a": (True, 1, 10), "b": (False, 3, 7)}


# --- sketches ------------------------------------------------------------------------------------


def test_sketches_of_overlapping_batches_merge(spark):
    edges = spark.range(30_000).select((F.col("id") % 300).alias("artist_alias"), F.col("id").alias("follower_alias"))
    parts = [activity.activity_sketches(edges.where(f"follower_alias % 3 <> {k}")) for k in range(3)]
    merged = activity.merged_activity(parts[0].unionByName(parts[1]).unionByName(parts[2])).head()
    assert abs(merged["edges"] - 30_000) < 600 and abs(merged["followers"] - 30_000) < 600 and abs(merged["artists"] - 300) <= 3
    none = activity.merged_activity(activity.activity_sketches(edges.limit(0))).head()
    assert (none["edges"], none["followers"], none["density"]) == (0, 0, None)


def test_documents_are_parsed_once_for_both_parts(spark):
    lines = spark.createDataFrame([('{"alias":"a","followers":[{"permalink":"x"},7]}',), ('{"alias":"b","followers":[]}',), ("{",), ('{"alias":"c"}',)], "line string")
    parts = tolerant.followers_of(lines)
    assert all("parse_json" not in p._jdf.queryExecution().optimizedPlan().toString() for p in parts)
    assert [(r.alias, r.position, r.follower.permalink) for r in parts[0].collect()] == [("a", 0, "x")]
    assert {tuple(r) for r in parts[1].collect()} == {("a", 1, "7", tolerant.NO_OBJECT), (None, None, "{", tolerant.NO_JSON)}
