"""Nested artist documents and tables in JSON lines or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from followgraph import schemas


def read_documents(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: T.StructType = schemas.DOCUMENT
) -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def write_documents(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "append") -> None:
    df.write.mode(mode).format(fmt).save(path)
