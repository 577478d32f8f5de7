"""Who follows how much, who is followed how much."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from followgraph import fixed


def follower_activity(edges: DataFrame, follower: str = "follower_alias") -> DataFrame:
    """Artists followed per follower, most active first."""
    return edges.groupBy(follower).agg(F.count("*").alias("count")).orderBy(F.desc("count"), follower)


def activity_thresholds(
    edges: DataFrame,
    artist: str = "artist_alias",
    follower: str = "follower_alias",
    thresholds: Sequence[int] = tuple(fixed.ACTIVITY_THRESHOLDS),
) -> DataFrame:
    """One row: edges, unique followers and artists, followers above each threshold, matrix density."""
    per_follower = edges.groupBy(follower).agg(F.count("*").alias("n")).select("n", F.lit(True).alias("is_follower"))
    per_artist = edges.groupBy(artist).agg(F.count("*").alias("n")).select("n", F.lit(False).alias("is_follower"))
    is_follower = F.col("is_follower")
    totals = per_follower.unionByName(per_artist).agg(
        F.coalesce(F.sum(F.when(is_follower, F.col("n"))), F.lit(0)).alias("edges"),
        F.count_if(is_follower).alias("followers"),
        F.count_if(~is_follower).alias("artists"),
        *[F.count_if(is_follower & (F.col("n") > k)).alias(f"over_{k}") for k in thresholds],
    )
    cells = F.col("followers").cast("double") * F.col("artists")
    return totals.withColumn("density", F.try_divide(F.col("edges"), cells))


def artist_popularity(edges: DataFrame, artists: DataFrame, key: str = "artist_alias") -> DataFrame:
    """Every artist with its stored followers and their share of the followers its profile states.

    Ascending by stored followers, the order in which artists are harvested.
    """
    stored = edges.groupBy(key).agg(F.count("*").alias("stored_followers"))
    return (
        artists.join(stored, key, "left")
        .withColumn("stored_followers", F.coalesce("stored_followers", F.lit(0)))
        .withColumn("completeness", F.try_divide(F.col("stored_followers"), F.col("followers_count")))
        .orderBy("stored_followers", key)
    )


def harvest_completeness(log: DataFrame) -> DataFrame:
    """Last report per alias: added, expected, their ratio, and the error if the harvest failed."""
    last = F.max_by(F.struct("added", "expected", "error"), F.struct("logged_at", "added")).alias("last")
    return (
        log.groupBy("alias")
        .agg(last, F.max("logged_at").alias("logged_at"), F.count("*").alias("reports"))
        .select(
            "alias",
            "logged_at",
            "reports",
            "last.added",
            "last.expected",
            F.try_divide(F.col("last.added"), F.col("last.expected")).alias("ratio"),
            F.col("last.error").alias("error"),
            F.col("last.error").isNotNull().alias("failed"),
        )
    )


def activity_sketches(edges: DataFrame, artist: str = "artist_alias", follower: str = "follower_alias", precision: int = 16) -> DataFrame:
    """One row of HyperLogLog sketches of a batch of edges, repeats included: of the edges, the followers and the artists.

    Sketches of batches are kept beside the batches and merged by ``merged_activity``, whatever edges several batches share, so a
    report needs no stored edge. With a precision of 16 each takes 64 KB at most and is off by about 0.4 per cent.
    """
    pair = F.xxhash64(artist, follower)
    whole = edges.where(F.col(artist).isNotNull() & F.col(follower).isNotNull())
    return whole.agg(
        F.hll_sketch_agg(pair, precision).alias("edges"),
        F.hll_sketch_agg(F.xxhash64(follower), precision).alias("followers"),
        F.hll_sketch_agg(F.xxhash64(artist), precision).alias("artists"),
    )


def merged_activity(sketches: DataFrame) -> DataFrame:
    """One row: about how many edges, followers and artists all batches have together, and the matrix density."""
    counts = [F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in ("edges", "followers", "artists")]
    cells = F.col("followers").cast("double") * F.col("artists")
    return sketches.agg(*counts).withColumn("density", F.try_divide(F.col("edges"), cells))
