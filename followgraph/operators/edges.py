"""Edges between followers and artists, and their integer ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from followgraph.operators.numbering import dense_ids


def artist_ids(artists: DataFrame, alias: str = "sc_alias") -> DataFrame:
    """(artist_id, artist_alias) of the artists."""
    return dense_ids(artists.select(F.col(alias).alias("artist_alias")), "artist_alias", "artist_id")


def follower_ids(profiles: DataFrame, alias: str = "follower_alias") -> DataFrame:
    """(follower_id, follower_alias) of the profiles."""
    return dense_ids(profiles.select(F.col(alias).alias("follower_alias")), "follower_alias", "follower_id")


def distinct_edges(df: DataFrame, artist: str = "artist_alias", follower: str = "follower_alias") -> DataFrame:
    """Distinct (artist, follower) pairs with both ends present."""
    return df.select(artist, follower).where(F.col(artist).isNotNull() & F.col(follower).isNotNull()).distinct()


def training_edges(edges: DataFrame, artists: DataFrame, followers: DataFrame) -> DataFrame:
    """Edges with both ids and the weight 1.

    Edges of unknown artists and of followers without a profile drop out. The ids are unique per
    alias, so the distinct edges stay distinct. No hints: the artist side is broadcast while Spark
    measures it as small, and skewed partitions are split at run time.
    """
    return (
        edges.join(artists, "artist_alias")
        .join(followers, "follower_alias")
        .select("artist_id", "follower_id", "artist_alias", "follower_alias", F.lit(1).alias("count"))
    )


def dropped_edges(edges: DataFrame, artists: DataFrame, followers: DataFrame) -> DataFrame:
    """How many edges lack an artist or a profile."""
    return (
        edges.join(artists.select("artist_alias", F.lit(True).alias("_a")).distinct(), "artist_alias", "left")
        .join(followers.select("follower_alias", F.lit(True).alias("_f")).distinct(), "follower_alias", "left")
        .agg(
            F.count_if(F.col("_a").isNull()).alias("without_artist"),
            F.count_if(F.col("_f").isNull()).alias("without_profile"),
        )
    )


def follower_profile(profiles: DataFrame) -> DataFrame:
    """One profile per follower: the row with the latest ``last_modified``, ties by all columns."""
    columns = [c for c in profiles.columns if c not in ("exception", "artist_num", "artist_follower_num", "artist_alias")]
    rest = [c for c in columns if c not in ("follower_alias", "last_modified")]
    newest = F.max(F.struct("last_modified", *rest)).alias("_newest")
    return profiles.groupBy("follower_alias").agg(newest).select("follower_alias", "_newest.*")
