"""The cleaned tables as SQL views, for ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from followgraph.operators import edges as E

# The view names that existing queries use.
EDGES, ARTISTS, FOLLOWERS = "artist_follower", "artists", "followers"
ARTIST_IDS, FOLLOWER_IDS = "custom_artist_id", "custom_follower_id"


def register_views(edges: DataFrame, artists: DataFrame, profiles: DataFrame) -> None:
    """Register edges, artists, followers and both id tables; a view of the same name is replaced."""
    edges.createOrReplaceTempView(EDGES)
    artists.createOrReplaceTempView(ARTISTS)
    profiles.createOrReplaceTempView(FOLLOWERS)
    E.artist_ids(artists).createOrReplaceTempView(ARTIST_IDS)
    E.follower_ids(profiles).createOrReplaceTempView(FOLLOWER_IDS)
