"""Factor vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_features(text: Column) -> Column:
    """``'[0.1, 2]'`` as ``array<double>``; text that is no list gives NULL."""
    return F.from_json(text, "array<double>")


def is_complete(vector: Column) -> Column:
    """False for NULL and empty vectors and for NULL, NaN or infinite elements."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & (F.size(vector) > 0), F.lit(False))


def has_cosine(vector: Column) -> Column:
    """True for complete vectors that are not all zero."""
    return is_complete(vector) & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
