"""Name cleaning, search phrases and text repair as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from followgraph import fixed

# The numbering suffix of catalogue names. The closing character is not looked at.
ONE_DIGIT_SUFFIX = r"(?s)^(.+) \([0-9].\z"
TWO_DIGIT_SUFFIX = r"(?s)^(.+) \([0-9][0-9].\z"


def strip_number_suffix(name: Column) -> Column:
    """``'Abc (3)'`` and ``'Abc (12)'`` become ``'Abc'``: one digit first, then two."""
    return F.regexp_replace(F.regexp_replace(name, ONE_DIGIT_SUFFIX, "$1"), TWO_DIGIT_SUFFIX, "$1")


def first_digits(text: Column) -> Column:
    """The first run of digits, or NULL."""
    return F.nullif(F.regexp_extract(text, "[0-9]+", 0), F.lit(""))


def search_phrase(name: Column, suffix: str = fixed.SEARCH_SUFFIX) -> Column:
    """The words of a name joined by ``+``, followed by the suffix."""
    words = F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+|\s+\z", ""), r"(?U)\s+", "+")
    return F.concat(words, F.lit(suffix))


@F.pandas_udf(T.StringType())
def _decoded(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"), na_action="ignore")


def drop_invalid_utf8(raw: Column) -> Column:
    """Text of a binary or string column without the bytes that are not UTF-8."""
    text = raw.cast("string")
    valid = F.is_valid_utf8(text)
    # Spark's own repair puts marks that genuine ones can't be told from; only broken texts reach Python
    return F.when(valid, text).otherwise(_decoded(F.when(~valid, raw.cast("binary"))))


def flag_is_zero(flag: Column) -> Column:
    """True for ``'0'``, ``'0.0'``, ``' 0 '``; text and NULL give NULL and so never pass a filter."""
    return F.expr("0D") == flag.try_cast("double")
