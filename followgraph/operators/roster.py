"""Rosters and artist metadata: union, cleaning, duplicates, legitimacy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from followgraph import fixed
from followgraph.functions.names import flag_is_zero, strip_number_suffix


def union_rosters(*rosters: DataFrame) -> DataFrame:
    """All rows of all rosters; columns that a roster lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rosters)


def deny_names(df: DataFrame, names: Sequence[str], column: str = "artist_name") -> DataFrame:
    """Drop the listed names; a NULL name is dropped too (its comparison is unknown)."""
    return df.where(~F.col(column).isin(list(names)))


def clean_roster(
    *rosters: DataFrame, denied: Sequence[str] = tuple(fixed.DENIED_ROSTER_NAMES), clean_last: bool = False
) -> DataFrame:
    """Distinct cleaned names of all rosters with the first source that has each.

    Names are cleaned, then denied, then deduplicated. ``clean_last`` denies and deduplicates the raw
    names and cleans afterwards, so duplicates and denied names can come back.
    """
    rows = union_rosters(*rosters)
    if not clean_last:
        rows = rows.withColumn("artist_name", strip_number_suffix(F.col("artist_name")))
    firsts = (
        deny_names(rows, denied)
        .groupBy("artist_name")
        .agg(F.min("source_rank").alias("source_rank"))
    )
    if clean_last:
        firsts = firsts.withColumn("artist_name", strip_number_suffix(F.col("artist_name")))
    return firsts


def legitimate(df: DataFrame, plan: Column | str = "plan", followers: Column | str = "followers_count") -> DataFrame:
    """Keep paid plans and accounts with enough followers."""
    plan = F.col(plan) if isinstance(plan, str) else plan
    followers = F.col(followers) if isinstance(followers, str) else followers
    return df.where(plan.isin(fixed.PAID_PLANS) | (followers >= fixed.MIN_FOLLOWERS))


def not_flagged(df: DataFrame, flag: str = "duplicate_flag") -> DataFrame:
    """Keep rows whose duplicate flag is zero, however it is spelled."""
    return df.where(flag_is_zero(F.col(flag)))


def unreadable_flags(df: DataFrame, flag: str = "duplicate_flag") -> DataFrame:
    """Rows with a flag that is no number, for the quality report."""
    return df.where(F.col(flag).isNotNull() & F.col(flag).try_cast("double").isNull())


def reviewed(df: DataFrame, review: str = "review") -> DataFrame:
    """Keep rows a reviewer marked."""
    return df.where(F.col(review) == fixed.REVIEW_KEEP)


def has_alias(df: DataFrame, alias: str = "sc_alias") -> DataFrame:
    """Keep rows whose alias was found."""
    return deny_names(df, fixed.ALIAS_SENTINELS, alias)


def override_aliases(df: DataFrame, overrides: DataFrame, name: str = "artist_name", alias: str = "sc_alias") -> DataFrame:
    """Put the alias of the hand-kept (name, alias) pairs in place of the resolved one.

    Several names may share an alias. Of repeated pairs for one name the smallest alias counts. No
    broadcast hint: Spark broadcasts the pairs by itself while they are below its size threshold.
    """
    pairs = overrides.groupBy(F.col(name).alias("_name")).agg(F.min(alias).alias("_alias"))
    return (
        df.join(pairs, F.col(name) == F.col("_name"), "left")
        .withColumn(alias, F.coalesce("_alias", alias))
        .drop("_name", "_alias")
    )


def duplicate_aliases(df: DataFrame, alias: str = "sc_alias", name: str = "artist_name") -> DataFrame:
    """Aliases held by several names, with the number of names."""
    return df.groupBy(alias).agg(F.countDistinct(name).alias("count")).where("count > 1")


def with_duplicate_count(df: DataFrame, duplicates: DataFrame, alias: str = "sc_alias") -> DataFrame:
    """Every row with the duplicate count of its alias, NULL when the alias is unique."""
    return df.join(duplicates, alias, "left")


def rows_to_review(df: DataFrame, duplicates: DataFrame, alias: str = "sc_alias") -> DataFrame:
    """Rows whose alias is on the duplicate list."""
    return df.join(duplicates.select(alias), alias, "left_semi")


def unique_rows(df: DataFrame, duplicates: DataFrame, alias: str = "sc_alias") -> DataFrame:
    """Rows whose alias is not on the duplicate list."""
    return df.join(duplicates.select(alias), alias, "left_anti")


def resolve_duplicates(
    df: DataFrame,
    alias: str = "sc_alias",
    name: str = "artist_name",
    page_name: str = "page_name",
    source_rank: str = "source_rank",
) -> DataFrame:
    """One row per alias: the name closest to the page's own, then the earlier source, then the name.

    ``rank = 1`` is cut to one row per alias in every task before the shuffle, so a hot alias costs
    nothing extra.
    """
    order = Window.partitionBy(alias).orderBy(
        F.levenshtein(F.lower(name), F.lower(page_name)).asc_nulls_last(), F.col(source_rank), F.col(name)
    )
    return df.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
