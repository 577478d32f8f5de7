"""Nested documents from flat rows and back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from followgraph import fixed, schemas
from followgraph.operators.numbering import dense_ids, ordered_positions

CHUNK_ROWS = 10_000
PROFILE_COLUMNS = schemas.PROFILE.fieldNames()[5:]


def nest(
    rows: DataFrame,
    key: str,
    order: Sequence[str],
    fields: Sequence[str],
    output: str = "followers",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Documents of at most ``chunk_rows`` elements: (key, first_follower_num, array of structs).

    A key with more rows gets several documents that continue each other's numbering, so no array
    and no task grows with the hottest key.
    """
    numbered = ordered_positions(rows, [F.col(c).asc_nulls_first() for c in order], keys=[key], output="_num")
    return (
        numbered.withColumn("_chunk", F.floor((F.col("_num") - 1) / chunk_rows))
        .groupBy(key, "_chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct("_num", F.struct(*fields).alias("_row")))).alias("_rows"),
            F.min("_num").alias("first_follower_num"),
        )
        .select(key, "first_follower_num", F.col("_rows._row").alias(output))
    )


def build_documents(
    artists: DataFrame, followers: DataFrame, order: Sequence[str] = ("permalink",), chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Artist documents with their followers; artists without followers keep an empty array.

    ``followers`` holds ``alias`` and the follower fields.
    """
    nested = nest(followers, "alias", order, schemas.FOLLOWER.fieldNames(), chunk_rows=chunk_rows)
    return (
        artists.join(nested, "alias", "left")
        .withColumn("followers", F.coalesce("followers", F.array().cast(schemas.DOCUMENT["followers"].dataType)))
        .withColumn("first_follower_num", F.coalesce("first_follower_num", F.lit(1).cast("bigint")))
        .withColumn("date_time", F.current_timestamp())
        .select(*schemas.DOCUMENT.fieldNames())
    )


def flatten(documents: DataFrame, key: str = "alias", array: str = "followers") -> DataFrame:
    """One row per array element: (key, artist_num, artist_follower_num, element fields).

    ``artist_num`` numbers the documents by key; ``artist_follower_num`` starts at 1 in each of them.
    """
    numbers = dense_ids(documents.select(key), key, "artist_num")
    first = F.coalesce("first_follower_num", F.lit(1)) if "first_follower_num" in documents.columns else F.lit(1)
    # Numbers are joined to whole documents, so no exploded row is shuffled.
    return (
        documents.join(numbers, key)
        .select(key, "artist_num", first.alias("_first"), F.posexplode(array).alias("_pos", "_row"))
        .select(key, "artist_num", (F.col("_first") + F.col("_pos")).cast("bigint").alias("artist_follower_num"), "_row.*")
    )


def flatten_documents(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edge rows, profile rows) of artist documents.

    A follower without an alias cannot become an edge; it stays in both tables with the reason in
    ``exception``.
    """
    rows = flatten(documents).withColumn(
        "exception",
        F.when(F.col("permalink").isNull(), F.lit("follower has no alias")).otherwise(F.lit(fixed.NO_EXCEPTION)),
    )
    common = [
        F.col("exception"),
        F.col("artist_num"),
        F.col("artist_follower_num"),
        F.col("alias").alias("artist_alias"),
        F.col("permalink").alias("follower_alias"),
    ]
    return rows.select(*common), rows.select(*common, *PROFILE_COLUMNS)
