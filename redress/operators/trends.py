"""Q4: how complaint volumes move over time.

``daily_trend``          count per day + 30-row trailing mean, cut by year
``trend_for_year``       the daily trend of one year (cut applied after smoothing)
``trend_year_domain``    the years the daily trend spans, with min and max
``category_trend``       per-day counts of each category on a dense date axis,
                         with a per-category trailing mean (responses, products)
``category_trend_for``   one category's series out of ``category_trend``
``category_trend_wide``  the per-day counts pivoted to one column per category
``top_issue_per_year``   the issue with the most complaints in each year

Windows are rows, not days: absent dates are not filled in, and the mean is
null until a full window of rows exists (pandas ``rolling(n).mean()``).

Scale: every window here runs on data already aggregated to one row per
calendar day (per category).  The daily trend's window has no partition key
and so runs in one task, over at most one row per calendar day in the span
(about 365 per year, whatever the table's size).  The category windows are
partitioned by category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redress.functions.labels import null_label
from redress.operators.grid import dense_grid

DATE = "date_received"


def _day(date_col: str) -> Column:
    return F.to_date(F.col(date_col)).alias(date_col)


def rolling_mean(
    df: DataFrame,
    value_col: str,
    order_col: str,
    window: int = 30,
    partition_cols: list[str] | None = None,
    out: str = "monthly_mva",
) -> DataFrame:
    """Trailing mean over ``window`` rows, null until ``window`` rows exist."""
    w = (
        Window.partitionBy(*(partition_cols or []))
        .orderBy(F.col(order_col).asc_nulls_first())
        .rowsBetween(-(window - 1), Window.currentRow)
    )
    return df.withColumn(
        out, F.when(F.count(F.lit(1)).over(w) >= window, F.avg(value_col).over(w))
    )


def daily_counts(c: DataFrame, date_col: str = DATE) -> DataFrame:
    """``COUNT(*)`` per calendar day; a null date is its own group."""
    return c.groupBy(_day(date_col)).agg(F.count(F.lit(1)).alias("count"))


def daily_trend(
    c: DataFrame, window: int = 30, min_year: int | None = None, date_col: str = DATE
) -> DataFrame:
    """``(date_received, count, monthly_mva)``.

    The year cut is applied *after* smoothing, so the first days kept carry a
    mean over days before the cut.  Catalyst cannot push it below this window
    (it has no partition key), so the order holds in the optimised plan.
    """
    trend = rolling_mean(daily_counts(c, date_col), "count", date_col, window)
    if min_year is not None:
        trend = trend.where(F.year(date_col) >= min_year)
    return trend


def trend_for_year(
    c: DataFrame, year: int | None = None, window: int = 30, min_year: int | None = None, date_col: str = DATE
) -> DataFrame:
    """The daily trend restricted to one year (after smoothing and the cut);
    ``None`` is the slider's default, the first year of the cut trend."""
    trend = daily_trend(c, window, min_year, date_col)
    if year is not None:
        return trend.where(F.year(date_col) == year)
    first = F.min(F.year(date_col)).over(Window.partitionBy())  # one row per day
    return trend.withColumn("_first", first).where(F.year(date_col) == F.col("_first")).drop("_first")


def trend_year_domain(
    c: DataFrame, min_year: int | None = None, window: int = 30, date_col: str = DATE
) -> DataFrame:
    """``(year, mark, year_min, year_max)``: one row per year of the cut trend.

    ``mark`` is the year as text (the slider's label); ``year_min`` is also
    the default selection.  The window spans the distinct years only.
    """
    years = (
        daily_trend(c, window, min_year, date_col)
        .where(F.col(date_col).isNotNull())
        .groupBy(F.year(date_col).alias("year"))
        .agg(F.count(F.lit(1)).alias("_days"))
    )
    every = Window.partitionBy()
    return years.select(
        "year",
        F.col("year").cast("string").alias("mark"),
        F.min("year").over(every).alias("year_min"),
        F.max("year").over(every).alias("year_max"),
    )


def year_marks(
    c: DataFrame, min_year: int | None = None, window: int = 30, date_col: str = DATE
) -> DataFrame:
    """``(marks MAP<STRING, STRING>)``: one row, the slider's marks by year."""
    years = trend_year_domain(c, min_year, window, date_col)
    entries = F.array_sort(F.collect_list(F.struct(F.col("mark").alias("key"), F.col("mark").alias("value"))))
    return years.agg(F.map_from_entries(entries).alias("marks"))


def category_daily_counts(c: DataFrame, category: str, date_col: str = DATE) -> DataFrame:
    """``COUNT(*)`` per (day, category) where the category is present."""
    return (
        c.where(F.col(category).isNotNull())
        .groupBy(_day(date_col), F.col(category))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def category_trend(
    c: DataFrame, category: str, window: int = 30, date_col: str = DATE
) -> DataFrame:
    """``(date_received, <category>, count, monthly_mva)`` on a dense grid.

    The date axis is every day on which any category occurs; a category
    absent on such a day counts 0 there (pivot + ``fillna(0)``), and the
    trailing mean runs over that axis per category.
    """
    counts = category_daily_counts(c, category, date_col)
    grid = dense_grid(counts, date_col, category, "count", fill=0)
    return rolling_mean(grid, "count", date_col, window, partition_cols=[category])


def category_trend_for(
    c: DataFrame,
    category: str,
    value: str | None = None,
    window: int = 30,
    date_col: str = DATE,
) -> DataFrame:
    """One category's smoothed series; ``value=None`` picks the alphabetically
    first category (the first pivot column).

    The grid still needs every category, since the date axis is the union of
    their days; the choice is applied to the grid before the per-category
    window.
    """
    counts = category_daily_counts(c, category, date_col)
    grid = dense_grid(counts, date_col, category, "count", fill=0)
    chosen = F.lit(value) if value is not None else counts.select(F.min(category)).scalar()
    grid = grid.where(F.col(category) == chosen)
    return rolling_mean(grid, "count", date_col, window, partition_cols=[category])


def category_trend_wide(
    c: DataFrame,
    category: str,
    categories: list[str] | None = None,
    date_col: str = DATE,
) -> DataFrame:
    """Per-day counts, one column per category, absent = 0 (``pivot().fillna(0)``).

    Pass ``categories`` when the domain is known; with ``None`` Spark finds
    the distinct values itself, which costs one extra aggregation job.
    """
    counts = category_daily_counts(c, category, date_col)
    wide = counts.groupBy(date_col).pivot(category, categories).agg(F.first("count"))
    value_cols = [x for x in wide.columns if x != date_col]
    return wide.na.fill(0, subset=value_cols)


def top_issue_per_year(
    c: DataFrame, date_col: str = DATE, issue: str = "issue", with_totals: bool = False
) -> DataFrame:
    """``(year, issue, count)``: the arg-max issue of each year;
    ``with_totals`` adds ``total``, the number of that year's complaints, and
    ``share``, the leading issue's part of it.

    Counts are per raw issue value; a null issue is labelled ``'Unknown'``
    only afterwards, with its real count.  Ties go to the smaller label.  A
    null year is dropped.
    """
    counts = (
        c.groupBy(F.year(date_col).alias("year"), F.col(issue))
        .agg(F.count(F.lit(1)).alias("count"))
        .where(F.col("year").isNotNull())
        .withColumn(issue, null_label(issue))
    )
    w = Window.partitionBy("year").orderBy(F.desc("count"), F.asc(issue))
    totals = []
    if with_totals:
        counts = counts.withColumn("total", F.sum("count").over(Window.partitionBy("year")).cast("long"))
        totals = ["total", (F.col("count") / F.col("total")).alias("share")]
    return (
        counts.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") == 1)
        .select("year", issue, "count", *totals)
    )
