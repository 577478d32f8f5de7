"""The test tables in the roles of the follower graph.

An artist is a part, a follower a customer, an edge a (part, customer) that share an order. Items with
factors are the embeddings, and part ``n`` names item ``n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (artist_id, follower_id) by the tables' own keys."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("artist_id"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("follower_id"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("artist_id", "follower_id").distinct()


def part_alias(key: str) -> F.Column:
    return F.concat(F.lit("part-"), F.col(key).cast("string"))


def customer_alias(key: str) -> F.Column:
    return F.concat(F.lit("Customer#"), F.lpad(F.col(key).cast("string"), 9, "0"))


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (artist_alias, follower_alias)."""
    return id_edges(spark, sf_dir).select(
        part_alias("artist_id").alias("artist_alias"), customer_alias("follower_id").alias("follower_alias")
    )


def artists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Artist metadata; the part type stands for the plan and the size for the stated followers."""
    return table(spark, sf_dir, "part").select(
        F.col("p_name").alias("artist_name"),
        part_alias("p_partkey").alias("sc_alias"),
        F.col("p_type").alias("plan"),
        F.col("p_size").cast("bigint").alias("followers_count"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follower profiles."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("follower_alias"),
        F.col("c_mktsegment").alias("plan"),
        F.col("c_nationkey").cast("bigint").alias("track_count"),
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, artist_alias, features) of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), part_alias("vec_id").alias("artist_alias"), F.col("embedding").alias("features")
    )
