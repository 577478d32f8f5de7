"""Appended tables: aliases, artist metadata, harvest log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from followgraph import schemas


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a Parquet table after putting the columns into the table's names, order and types.

    All rows of the DataFrame become visible together when the job commits. For a relational target use
    ``df.write.mode('append').jdbc(...)`` with the same columns.
    """
    df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("append").parquet(path)


def append_aliases(df: DataFrame, path: str) -> None:
    append_rows(df, path, T.StructType([f for f in schemas.ALIAS.fields if f.name != "id"]))


def append_artists(df: DataFrame, path: str) -> None:
    fields = [f for f in schemas.ARTIST.fields if f.name not in ("index", "id", "count", "duplicate_flag")]
    append_rows(df, path, T.StructType(fields))


def append_harvest_log(df: DataFrame, path: str) -> None:
    """One row per progress report; ``logged_at`` is the UTC time of the write when it is missing."""
    if "logged_at" not in df.columns:
        df = df.withColumn("logged_at", F.current_timestamp())
    if "error" not in df.columns:
        df = df.withColumn("error", F.lit(None).cast("string"))
    append_rows(df, path, schemas.HARVEST_LOG)


def read_harvest_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.HARVEST_LOG).parquet(path)
