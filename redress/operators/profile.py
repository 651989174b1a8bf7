"""Table profile: null counts per column and a small ordered sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redress.sources.complaints import NULL_PROFILE_COLUMNS


def missing_counts(c: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row, ``<col>_missing_count`` for each column, in one pass."""
    cols = list(NULL_PROFILE_COLUMNS if columns is None else columns)
    return c.agg(*[F.count_if(F.col(x).isNull()).alias(f"{x}_missing_count") for x in cols])


def sample_rows(c: DataFrame, n: int = 5) -> DataFrame:
    """``SELECT * ... LIMIT n`` made repeatable: the first ``n`` rows in the
    order of all columns (nulls first).  Planned as a per-partition top-n
    (``TakeOrderedAndProject``), so no full sort."""
    order = [F.col(x).asc_nulls_first() for x in c.columns]
    return c.orderBy(*order).limit(n)


def sample_records(c: DataFrame, n: int = 5) -> DataFrame:
    """The sample as JSON records (``to_dict('records')``), one string per
    row; like pandas, every column is a key, nulls included."""
    record = F.to_json(F.struct(*c.columns), {"ignoreNullFields": "false"})
    return sample_rows(c, n).select(record.alias("record"))
