"""Densify a sparse two-key table: every (row key, column key) pair, absent = fill.

pandas' ``pivot(...).fillna(0)`` and ``crosstab`` both produce the full
grid of the observed row keys by the observed column keys.  The grid is the
result itself, so its size is the output size.  The column keys are one
scalar subquery over the aggregated cells; every row key explodes them, and
the observed cells are joined to that on both keys.  All branches start from
the same aggregated cells, so Spark reuses their exchange and the input is
read once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_grid(cells: DataFrame, row: str, col: str, value: str, fill=0) -> DataFrame:
    """``cells`` holds at most one row per (row, col) with both keys non-null.

    Returns ``(row, col, value)`` for every observed row key by every observed
    column key, with ``fill`` where the pair was not observed.  A null row key
    is a key like any other.
    """
    domain = cells.select(F.array_sort(F.collect_set(col))).scalar()
    axis = cells.select(F.col(row).alias("_row")).distinct()
    grid = axis.select("_row", F.explode(domain).alias("_col"))
    same = grid["_row"].eqNullSafe(cells[row]) & (grid["_col"] == cells[col])
    return grid.join(cells, same, "left").select(
        F.col("_row").alias(row), F.col("_col").alias(col), F.coalesce(F.col(value), F.lit(fill)).alias(value)
    )
