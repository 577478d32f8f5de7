"""Item factors on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from followgraph import schemas
from followgraph.functions.vectors import parse_features
from followgraph.sources.delimited import read_delimited, sound_rows


def export_factors(factors: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store (id, artist_alias, features): the alias goes with the factors, ids alone do not survive a retraining."""
    factors.select("id", "artist_alias", "features").write.mode(mode).parquet(path)


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_factor_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, features) of a CSV export that holds the features as the text of a list."""
    rows = sound_rows(read_delimited(spark, path, schemas.ITEM_FACTORS_FILE))
    return rows.select("id", parse_features(F.col("features")).alias("features"))
