"""Row numbers equal the window function's, also with hot keys."""

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import Window, functions as F

from followgraph.operators.numbering import dense_ids, ordered_positions, row_range


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=4), min_size=1, max_size=30))
def test_ids_are_dense_and_in_byte_order(spark, aliases):
    rows = spark.createDataFrame([(a,) for a in aliases], "alias STRING")
    got = {r.alias: r.id for r in dense_ids(rows, "alias", "id").collect()}
    assert got == {a: i + 1 for i, a in enumerate(sorted(set(aliases), key=lambda a: a.encode()))}


def test_null_alias_gets_no_id_unless_asked(spark):
    rows = spark.createDataFrame([("b",), (None,), ("B",), ("é",), ("a",), (None,)], "alias STRING")
    got = {r.alias: r.id for r in dense_ids(rows, "alias", "id").collect()}
    assert got == {"B": 1, "a": 2, "b": 3, "é": 4}
    got = {r.alias: r.id for r in dense_ids(rows, "alias", "id", keep_null=True).collect()}
    assert got == {None: 1, "B": 2, "a": 3, "b": 4, "é": 5}


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_positions_with_a_hot_and_a_null_key(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 40).cast("string")).alias("key"),
            F.xxhash64("id").alias("value"),
        )
        got = ordered_positions(rows, [F.desc("value")], keys=["key"])
        want = rows.withColumn("position", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("value"))).cast("bigint"))
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_row_range_is_half_open(spark):
    rows = spark.range(100).withColumn("name", F.format_string("n%03d", 99 - F.col("id")))
    got = row_range(rows, [F.col("name").asc()], 6, 9).orderBy("position").collect()
    assert [(r.name, r.position) for r in got] == [("n006", 6), ("n007", 7), ("n008", 8)]


def test_no_task_numbers_a_whole_table(spark):
    plan = dense_ids(spark.range(10).select(F.col("id").cast("string").alias("a")), "a", "id")._jdf.queryExecution().toString()
    assert "row_number" not in plan
