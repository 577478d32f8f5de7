"""Explicit schemas of the tables and documents (nothing is inferred)."""

from __future__ import annotations

from pyspark.sql import types as T


def columns(**types: str) -> T.StructType:
    """StructType from ``name="type"`` pairs in the order given."""
    schema = T.StructType()
    for name, kind in types.items():
        schema = schema.add(name, "long" if kind == "bigint" else "integer" if kind == "int" else kind)
    return schema


ROSTER = columns(artist_name="string", source="string", source_rank="int")
ROSTER_FILE = columns(index="int", artist_name="string")
ALIAS = columns(id="int", artist_name="string", sc_alias="string")
DUPLICATE = columns(sc_alias="string", count="bigint")

ARTIST = columns(
    index="int",
    id="int",
    artist_name="string",
    sc_alias="string",
    city="string",
    country="string",
    followers_count="bigint",
    followings_count="bigint",
    last_modified="string",
    playlist_count="bigint",
    plan="string",
    public_favorites_count="bigint",
    track_count="bigint",
    count="int",
    duplicate_flag="string",
)

EDGE = columns(
    exception="string",
    artist_num="int",
    artist_follower_num="bigint",
    artist_alias="string",
    follower_alias="string",
)

PROFILE = T.StructType(
    EDGE.fields
    + columns(
        comments_count="bigint",
        followers_count="bigint",
        followings_count="bigint",
        last_modified="string",
        likes_count="bigint",
        plan="string",
        playlist_count="bigint",
        public_favorites_count="bigint",
        reposts_count="bigint",
        track_count="bigint",
        uri="string",
        username="string",
    ).fields
)

FOLLOWER = columns(
    city="string",
    comments_count="bigint",
    country="string",
    followers_count="bigint",
    followings_count="bigint",
    last_modified="string",
    likes_count="bigint",
    playlist_count="bigint",
    public_favorites_count="bigint",
    plan="string",
    reposts_count="bigint",
    track_count="bigint",
    uri="string",
    username="string",
    permalink="string",
)

DOCUMENT = (
    columns(
        artist="string",
        alias="string",
        city="string",
        country="string",
        followers_count="bigint",
        followings_count="bigint",
        last_modified="string",
        playlist_count="bigint",
        plan="string",
        public_favorites_count="bigint",
        track_count="bigint",
    )
    .add("followers", T.ArrayType(FOLLOWER))
    .add("first_follower_num", "long")
    .add("date_time", "timestamp")
)

ITEM_FACTORS = columns(id="int").add("features", T.ArrayType(T.FloatType()))
ITEM_FACTORS_FILE = columns(index="int", id="int", features="string")
SIMILAR = columns(artist_id="int", rank="int", similar_id="int", cosine="double")

HARVEST_LOG = columns(
    added="bigint",
    expected="bigint",
    alias="string",
    artist_index="int",
    total_artists="int",
    logged_at="timestamp",
    error="string",
)

FOLLOW = columns(artist_alias="string", follower_alias="string")
STORED_FOLLOW = columns(artist_alias="string", follower_alias="string", stream="string", batch_id="bigint", bucket="int")
