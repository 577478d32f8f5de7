"""Elements of raw web pages as rows: roster names from link lists and search results."""

from __future__ import annotations

import html
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from followgraph import fixed

# Quoted values may hold any character; the possessive repeats keep long attributes off the stack.
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_SKIPPED = r"<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
_ATTRIBUTE = r"""[^\s=/"'>]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
_VOID = r"area|br|col|embed|hr|img|input|link|meta|source|wbr"
_OPENINGS = rf"(?:<(?!(?:{_VOID})\b)[a-z]{_ATTRIBUTES}>)*+"
NO_CONTENT = "element does not start with text"


@F.pandas_udf(T.StringType())
def unescape(text: pd.Series) -> pd.Series:
    """Named and numeric character references as characters (Spark has no built-in for it)."""
    return text.map(html.unescape, na_action="ignore")


def _attribute_tokens(attributes: Column) -> Column:
    return F.regexp_extract_all(attributes, F.lit(_ATTRIBUTE), F.lit(0))


def _token_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^[^\s=]+", 0))


def _has(tokens: Column, name: str) -> Column:
    return F.exists(tokens, lambda t: _token_name(t) == name)


def _value(tokens: Column, name: str) -> Column:
    token = F.element_at(F.filter(tokens, lambda t: _token_name(t) == name), -1)
    return F.regexp_extract(token, r"""(?s)^[^\s=]+(?:\s*=\s*["']?(.*?)["']?)?\z""", 1)


def extract_elements(
    pages: DataFrame,
    tag: str,
    required: Sequence[str] = (),
    value_attribute: str | None = None,
    html_column: str = "html",
) -> DataFrame:
    """One row per ``tag`` element that has all ``required`` attributes, in page order.

    ``value`` is the named attribute or, without one, the text of the element's first child. An
    element that is empty or starts with an image has a NULL value and an ``error``. Comments, scripts and styles do not
    count, and neither do tags quoted inside attributes. The page text stays in the JVM; only the
    extracted values go through Arrow for character references.
    """
    opening = rf"<{tag}(?=[\s/>]){_ATTRIBUTES}>"
    any_tag = rf"<[a-z/!?]{_ATTRIBUTES}>"
    first_text = "" if value_attribute else rf"(?:(?!<{tag}[\s/>]){_OPENINGS}[^<]*+)?"
    scan = rf"(?is){_SKIPPED}|{opening}{first_text}|{any_tag}"
    is_element = rf"(?is)^{opening}"
    found = F.filter(
        F.regexp_extract_all(html_column, F.lit(scan), F.lit(0)), lambda piece: F.rlike(piece, F.lit(is_element))
    )
    elements = (
        pages.where(F.rlike(html_column, F.lit(rf"(?i)<{tag}[\s/>]")))
        .select(*[c for c in pages.columns if c != html_column], F.posexplode(found).alias("element_pos", "_piece"))
        .withColumn(
            "_tokens",
            _attribute_tokens(F.regexp_extract("_piece", rf"(?is)^<{tag}({_ATTRIBUTES})>", 1)),
        )
    )
    for name in required:
        elements = elements.where(_has(F.col("_tokens"), name))
    if value_attribute:
        raw = _value(F.col("_tokens"), value_attribute)
        elements = elements.withColumn("value", raw).withColumn("error", F.lit(None).cast("string"))
    else:
        rest = F.regexp_replace("_piece", is_element, "")
        raw = F.regexp_replace(rest, rf"(?is)^{_OPENINGS}", "")
        elements = elements.withColumn("value", F.when(rest != "", raw)).withColumn(
            "error", F.when(rest == "", F.lit(NO_CONTENT))
        )
    return elements.drop("_piece", "_tokens").withColumn("value", unescape("value"))


def link_list_names(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Names of a link list: the text of every anchor that has a title."""
    return extract_elements(pages, "a", ["title"], html_column=html_column)


def search_result_names(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """Names of search results: the title of every span that has a title and an itemprop."""
    return extract_elements(pages, "span", ["title", "itemprop"], "title", html_column=html_column)


def as_roster(elements: DataFrame, source: str, source_rank: int, keep_errors: bool = False) -> DataFrame:
    """Roster rows of extracted elements.

    Failed elements are left out; ``keep_errors`` keeps them as names that start with ``Exception``.
    """
    name = F.col("value")
    if keep_errors:
        name = F.coalesce(name, F.concat(F.lit(fixed.EXCEPTION_PREFIX), F.col("error")))
    return elements.select(
        name.alias("artist_name"), F.lit(source).alias("source"), F.lit(source_rank).alias("source_rank")
    ).where(F.col("artist_name").isNotNull())
