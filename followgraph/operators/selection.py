"""Rows by their place in an order, without sorting or moving the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from followgraph.operators.numbering import ordered_positions

_BOUNDS = 24  # keys that a round compares every row with
_FEW = 50_000  # rows between two bounds that need no narrower ones
_ROUNDS = 12


@dataclass(frozen=True)
class Key:
    """A column of an order. Nulls come first when ascending and last when descending."""

    column: str
    ascending: bool = True

    def sorted(self) -> Column:
        return F.col(self.column).asc_nulls_first() if self.ascending else F.col(self.column).desc_nulls_last()


def _before(order: Sequence[Key], bound: Row, types: dict[str, object]) -> Column:
    """Whether a row comes before ``bound``."""
    found: Column = F.lit(False)
    for key in reversed(order):
        value, cell = bound[key.column], F.col(key.column)
        other = F.lit(value).cast(types[key.column])
        smaller = F.lit(False) if value is None else F.coalesce(cell < other, F.lit(True))
        larger = cell.isNotNull() if value is None else F.coalesce(cell > other, F.lit(False))
        found = (smaller if key.ascending else larger) | (cell.eqNullSafe(other) & found)
    return found


def select_range(df: DataFrame, order: Sequence[Key], start: int, stop: int, output: str = "position") -> DataFrame:
    """Rows ``start`` (0-based) up to but without ``stop`` in the given order, with their 0-based position.

    The two ends are found by counting: every row is counted between sampled keys, then between keys of the part that holds an end,
    until that part is small. Only the columns of the order are read for it, and nothing is moved. Then the rows between the
    two bounds, about as many as were asked for, are numbered. Rows that are equal in all columns of the order get
    positions in any order among themselves; however many they are, they are numbered over range partitions. ``df`` should be a stored table, as it is read several times.
    """
    if start < 0 or stop <= start:
        return df.limit(0).withColumn(output, F.lit(0).cast("bigint"))
    keys = df.select(*[k.column for k in order])
    low, skipped = _bound(keys, order, start, after=False)
    if low is None and skipped:  # the table ends before
        return df.limit(0).withColumn(output, F.lit(0).cast("bigint"))
    high, _ = _bound(keys, order, stop, after=True)
    types = {f.name: f.dataType for f in keys.schema.fields}
    rows = df
    if low is not None:
        rows = rows.where(~_before(order, low, types))
    if high is not None:
        rows = rows.where(_before(order, high, types))
    numbered = ordered_positions(rows, [k.sorted() for k in order], output=output)
    place = F.col(output) - 1 + skipped
    return numbered.withColumn(output, place.cast("bigint")).where((F.col(output) >= start) & (F.col(output) < stop))


def _bound(keys: DataFrame, order: Sequence[Key], place: int, after: bool) -> tuple[Row | None, int]:
    """A key at or before the row at ``place`` (``after``: beyond the row before it), near it, and how many rows come before that key.

    None stands for an end of the table.
    """
    types = {f.name: f.dataType for f in keys.schema.fields}
    low: Row | None = None
    high: Row | None = None
    before_low, before_high = 0, keys.count()
    if place >= before_high:
        return None, before_high
    for _ in range(_ROUNDS):
        if before_high - before_low <= _FEW:
            break
        part = keys
        if low is not None:
            part = part.where(~_before(order, low, types))
        if high is not None:
            part = part.where(_before(order, high, types))
        share = min(1.0, 40.0 * _BOUNDS / (before_high - before_low))
        drawn = part.sample(share, seed=place & 0x7FFFFFFF).distinct().orderBy(*[k.sorted() for k in order]).limit(80 * _BOUNDS).collect()
        bounds = drawn[:: max(1, len(drawn) // _BOUNDS)]
        bounds = [b for b in bounds if b != low]
        if not bounds:
            break  # one key holds all rows of the part
        counts = part.agg(*[F.count_if(_before(order, b, types)).alias(f"c{k}") for k, b in enumerate(bounds)]).head()
        ranks = [before_low + counts[k] for k in range(len(bounds))]
        lower = [(r, b) for r, b in zip(ranks, bounds) if r <= place and (not after or r < place)]
        upper = [(r, b) for r, b in zip(ranks, bounds) if r > place or (after and r >= place)]
        narrowed = (lower[-1][0] if lower else before_low, upper[0][0] if upper else before_high)
        if narrowed == (before_low, before_high):
            break
        if lower:
            before_low, low = lower[-1]
        if upper:
            before_high, high = upper[0]
    return (high, before_high) if after else (low, before_low)

