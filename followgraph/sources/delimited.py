"""CSV in and out, with quarantine of broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from followgraph import schemas

CORRUPT = "_corrupt_record"


def read_delimited(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """Typed CSV; a row that does not fit the schema keeps its text in ``_corrupt_record``.

    Quotes inside quotes are doubled, as most CSV writers do. ``multi_line`` allows line breaks in
    quoted fields but makes each file one task: use it for files with free text, in many files.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    return (
        spark.read.schema(with_corrupt)
        .option("header", header)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        # A pruned read would not notice a row with too few columns.
        .option("columnPruning", False)
        .csv(path)
    )


def read_untyped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Headerless read: every column is a string named ``_c0``, ``_c1``, ..."""
    return spark.read.option("escape", '"').csv(path)


def by_position(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """The columns at the given positions under new names; the others are left out."""
    return df.select(*[F.col(df.columns[position]).alias(name) for position, name in names.items()])


def sound_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantined_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNotNull())


def drop_repeated_headers(df: DataFrame, column: str, title: str) -> DataFrame:
    """Drop header rows left inside the data; NULL in the column drops the row as well."""
    return df.where(F.col(column) != title)


def read_edges(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct (artist_alias, follower_alias), of sound and of error rows alike.

    A row written a second time with an error text in front is the same edge, so it falls to the
    distinct. Repeated header rows fail the number columns and are dropped.
    """
    rows = read_delimited(spark, path, schemas.EDGE)
    return (
        drop_repeated_headers(rows, "artist_alias", "artist_alias")
        .where(F.col("follower_alias").isNotNull())
        .select("artist_alias", "follower_alias")
        .distinct()
    )


def read_artists(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Artist metadata, all rows; the duplicate flag is still a string here."""
    rows = read_delimited(spark, path, schemas.ARTIST, multi_line=True)
    return drop_repeated_headers(sound_rows(rows), "artist_name", "artist_name")


def read_profiles(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Follower profiles: (sound rows, quarantined rows such as the short rows of failed profiles)."""
    rows = read_delimited(spark, path, schemas.PROFILE, multi_line=True)
    rows = drop_repeated_headers(rows, "artist_alias", "artist_alias")
    return sound_rows(rows), quarantined_rows(rows)


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header that ``read_delimited`` reads back; arrays become JSON text."""
    columns = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*columns).write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)
