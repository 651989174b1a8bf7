"""The place of every row of a result in its display order.

A sorted result loses its order as soon as it is stored or joined, so the
order is a column.  Numbering needs no single task: rows are dealt to ranges
of the order and sorted there, every range counts its rows, and a row's place
is its place in the range plus the rows of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redress.session import stored


def display_order(df: DataFrame, *lead: Column) -> list[Column]:
    """``lead``, then every column of ``df`` ascending, nulls first: a total
    order but for rows that are equal."""
    return [*lead, *[F.asc_nulls_first(c) for c in df.columns]]


def with_position(df: DataFrame, *lead: Column, out: str = "position") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of ``lead``,
    ties by all columns ascending.

    The dealt rows are stored once: counts and places are of the same ranges,
    also after a lost executor.  The windows run over one row per range."""
    order = display_order(df, *lead)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(ranged.select("*", F.monotonically_increasing_id().alias("_row")), "ordered")
    part, place = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    sizes = held.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = held.withColumn("_range", part).join(sizes, "_range")
    return numbered.select(*df.columns, (place + F.col("_before") + 1).cast("long").alias(out))
