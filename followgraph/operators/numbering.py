"""Row numbers that never pull a table, or one hot key, into a single task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from followgraph.session import written

_ROW_BITS = 33  # monotonically_increasing_id keeps the row in the low 33 bits, the partition above


def ordered_positions(
    df: DataFrame,
    order: Sequence[Column],
    keys: Sequence[str] = (),
    output: str = "position",
) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without one task per key.

    The rows are range-partitioned on (keys, order), so a key holding a third of the table spreads
    over a third of the partitions. The partitioned rows are written once, because range bounds are
    sampled and must not change between counting and numbering. The offset of a partition is the
    number of rows of the same key in earlier partitions; only the first key of a partition can have
    one, so the offset table has at most one row per partition and may be broadcast.
    """
    key_columns = [F.col(k).asc_nulls_first() for k in keys]
    ranged = (
        df.repartitionByRange(*key_columns, *order)
        .sortWithinPartitions(*key_columns, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
    )
    rows = (
        written(ranged, "positions")
        .withColumn("_part", F.shiftright("_slot", _ROW_BITS))
        .withColumn("_slot", F.col("_slot").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("_part", *keys)
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(earlier))
        .where("_before > 0")
        .select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], "_before")
    )
    if keys:
        local = F.row_number().over(Window.partitionBy("_part", *keys).orderBy("_slot")).cast("bigint")
    else:
        local = F.col("_slot") + 1
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        rows.withColumn("_local", local)
        .join(F.broadcast(offsets), same, "left")
        .select(*df.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(output))
    )


def dense_ids(df: DataFrame, alias: str, id_column: str, keep_null: bool = False) -> DataFrame:
    """Dense 1-based integer ids of the distinct aliases, in byte order.

    ``keep_null`` numbers a NULL alias first, as a global SQL ``row_number`` would. It never joins to
    an edge, so by default it gets no id and the other ids start at 1.
    """
    aliases = df.select(alias).distinct()
    if not keep_null:
        aliases = aliases.where(F.col(alias).isNotNull())
    numbered = ordered_positions(aliases, [F.col(alias).asc_nulls_first()], output=id_column)
    # ALS takes ids in the int range only; under ANSI the cast fails loudly beyond it.
    return numbered.select(F.col(id_column).cast("int").alias(id_column), alias)


def row_range(df: DataFrame, order: Sequence[Column], start: int, stop: int, output: str = "position") -> DataFrame:
    """Rows ``start`` (0-based) up to but without ``stop`` in the given order, with their 0-based position."""
    positions = ordered_positions(df, order, output=output).withColumn(output, F.col(output) - 1)
    return positions.where((F.col(output) >= start) & (F.col(output) < stop))
