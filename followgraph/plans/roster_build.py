"""From pages and resolved aliases to the artist metadata that is harvested."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from followgraph.functions.links import alias_from_url
from followgraph.functions.names import search_phrase
from followgraph.operators import roster as R
from followgraph.sources import pages as P


def roster_from_pages(list_pages: DataFrame, search_pages: DataFrame) -> DataFrame:
    """(artist_name, source_rank, search_phrase): cleaned names of both page sources, the list first."""
    names = R.clean_roster(
        P.as_roster(P.link_list_names(list_pages), "list", 1),
        P.as_roster(P.search_result_names(search_pages), "search", 2),
    )
    return names.withColumn("search_phrase", search_phrase(F.col("artist_name")))


def resolve_aliases(found: DataFrame, overrides: DataFrame) -> DataFrame:
    """Alias per name from the address (``result_url``) a search found, with the hand-kept pairs on top."""
    resolved = found.withColumn("sc_alias", alias_from_url(F.col("result_url")))
    return R.has_alias(R.override_aliases(resolved, overrides))


def harvest_list(artists: DataFrame, reviewed: DataFrame | None = None) -> DataFrame:
    """Legitimate artists with one name per alias, ascending by followers.

    With ``reviewed`` (rows with a ``review`` column) the reviewer's choice decides about duplicate
    aliases; without it the closest name does.
    """
    duplicates = R.duplicate_aliases(artists)
    unique = R.unique_rows(artists, duplicates)
    if reviewed is None:
        chosen = R.resolve_duplicates(R.rows_to_review(artists, duplicates))
    else:
        chosen = R.reviewed(reviewed).drop("review")
    return R.legitimate(R.union_rosters(chosen, unique)).orderBy("followers_count", "sc_alias")
