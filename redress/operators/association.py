"""Q3: is the submission channel associated with the company's response?

``channel_response_counts``  ``COUNT(*)`` per (channel, response), nulls kept
``contingency_cells``        observed cells of a two-way table, nulls dropped
``crosstab``                 the dense contingency table in long form
``crosstab_wide``            the same, one column per column key
``expected_counts``          dense table of observed and expected counts
``chi_square_statistic``     one-row statistic: chi2, dof, table size
``chi_square``               the report: statistic, p-value, dof, verdict

``weight`` chooses what a cell counts:

* ``'count'`` (default): complaints, i.e. the test of independence on the
  raw rows, as the reference's text describes it;
* ``'presence'``: 1 for every pair that occurs, which is what the
  reference computes, since it cross-tabulates its already-aggregated
  (channel, response) frame.

Scale: the raw rows are touched once, by a group-by on two low-cardinality
keys.  The statistic needs no dense grid: with margins r_i, c_j and total n,
the cells that were not observed contribute their expected count and
sum(e) = n, so

    chi2 = sum_observed (o - e)^2 / e  +  (n^2 - sum_observed r_i c_j) / n,

the second term in exact integer (decimal) arithmetic.

Yates' correction (dof = 1, a 2x2 table) uses that |o - e| is the same in
all four cells and sum(1/e) = n * sum_i(1/r_i) * sum_j(1/c_j).  Everything
is one aggregation over the observed cells, their margins attached by
windows over those cells and n by a scalar subquery over them (the raw rows
are read once).  Only
the p-value needs a Python helper (the incomplete gamma function), applied
to the single result row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redress.functions.stats import chi2_p_value
from redress.operators.counts import with_totals as stacked_totals
from redress.operators.grid import dense_grid

CHANNEL = "submitted_via"
RESPONSE = "company_response_to_consumer"

# The verdict texts of the reference's report.
REJECT_TEXT = (
    "The p-value is less than 0.05, we reject the null hypothesis and conclude that there is a "
    "significant relationship between the submission method and the company response."
)
ACCEPT_TEXT = (
    "The p-value is greater than 0.05, we fail to reject the null hypothesis. This suggests that "
    "there's no statistically significant relationship between the method used to submit the "
    "complaint (submitted_via) and the response from the company (company_response_to_consumer)."
)


def _with_alpha(text: str, alpha: float) -> str:
    """A verdict text at another level than 0.05."""
    return text if alpha == 0.05 else text.replace("0.05", f"{alpha:g}")


def channel_response_counts(
    c: DataFrame, row: str = CHANNEL, col: str = RESPONSE, with_totals: bool = False
) -> DataFrame:
    """``(submitted_via, company_response_to_consumer, Count_Response)``;
    ``with_totals`` adds ``total``, the stacked bar's height per channel."""
    counts = c.groupBy(row, col).agg(F.count(F.lit(1)).alias("Count_Response"))
    return stacked_totals(counts, row, "Count_Response") if with_totals else counts


def contingency_cells(
    c: DataFrame, row: str = CHANNEL, col: str = RESPONSE, weight: str = "count"
) -> DataFrame:
    """``(row, col, observed)`` for the pairs that occur, both keys non-null."""
    if weight not in ("count", "presence"):
        raise ValueError(f"weight must be 'count' or 'presence', not {weight!r}")
    cells = (
        c.where(F.col(row).isNotNull() & F.col(col).isNotNull())
        .groupBy(row, col)
        .agg(F.count(F.lit(1)).alias("observed"))
    )
    if weight == "presence":
        cells = cells.withColumn("observed", F.lit(1).cast("long"))
    return cells


def crosstab(
    c: DataFrame, row: str = CHANNEL, col: str = RESPONSE, weight: str = "count"
) -> DataFrame:
    """Dense contingency table ``(row, col, n)``: every observed row key by
    every observed column key, 0 where the pair does not occur."""
    cells = contingency_cells(c, row, col, weight)
    return dense_grid(cells, row, col, "observed", fill=0).withColumnRenamed("observed", "n")


def crosstab_wide(
    c: DataFrame,
    row: str = CHANNEL,
    col: str = RESPONSE,
    weight: str = "count",
    columns: list[str] | None = None,
) -> DataFrame:
    """``pd.crosstab`` layout: one row per row key, one column per column key.

    With ``columns=None`` Spark finds the column keys itself (one extra
    aggregation job).
    """
    cells = contingency_cells(c, row, col, weight)
    wide = cells.groupBy(row).pivot(col, columns).agg(F.first("observed"))
    return wide.na.fill(0, subset=[x for x in wide.columns if x != row])


def _with_margins(cells: DataFrame, row: str, col: str, value: str = "observed") -> DataFrame:
    """Attach row total ``_r`` and column total ``_c``, and the numbers of
    cells ``_kr`` and ``_kc`` of the row and column, to each cell, by windows
    partitioned by the keys."""
    by_row, by_col = Window.partitionBy(row), Window.partitionBy(col)
    return (
        cells.withColumn("_r", F.sum(value).over(by_row)).withColumn("_kr", F.count(F.lit(1)).over(by_row))
        .withColumn("_c", F.sum(value).over(by_col)).withColumn("_kc", F.count(F.lit(1)).over(by_col))
    )


def _total(cells: DataFrame, value: str = "observed"):
    """The grand total as a scalar subquery over the aggregated cells."""
    return cells.select(F.sum(value)).scalar()


def expected_counts(
    c: DataFrame, row: str = CHANNEL, col: str = RESPONSE, weight: str = "count"
) -> DataFrame:
    """``(row, col, observed, expected)`` over the dense table; expected =
    row total x column total / n (the ``expected`` array of the test)."""
    cells = contingency_cells(c, row, col, weight)
    grid = _with_margins(dense_grid(cells, row, col, "observed", fill=0), row, col)
    return grid.select(
        row,
        col,
        F.col("observed").cast("long").alias("observed"),
        (F.col("_r").cast("double") * F.col("_c").cast("double") / _total(cells).cast("double")).alias(
            "expected"
        ),
    )


def chi_square_statistic(
    c: DataFrame,
    row: str = CHANNEL,
    col: str = RESPONSE,
    weight: str = "count",
    correction: bool = True,
) -> DataFrame:
    """One row ``(chi2, dof, n_rows, n_cols, n)``.

    Matches ``scipy.stats.chi2_contingency``: Yates' correction when
    dof = 1 (unless ``correction=False``); dof = 0 gives chi2 0.  Plain sums
    over the observed cells, so the last digits of ``chi2`` depend on the
    order in which partial sums meet; integer parts are exact.
    """
    cells = contingency_cells(c, row, col, weight)
    n = F.coalesce(_total(cells).cast("double"), F.lit(0.0))
    o, r, k = (F.col(x).cast("double") for x in ("observed", "_r", "_c"))
    e = r * k / n
    exact = "decimal(38,0)"
    sums = _with_margins(cells, row, col).agg(
        F.sum((o - e) * (o - e) / e).alias("_terms"),
        F.sum("observed").alias("_n"),
        F.sum(F.col("_r").cast(exact) * F.col("_c").cast(exact)).alias("_obs_rc"),
        # each row and column once: its share of a cell, over its cells
        F.sum(1.0 / F.col("_kr")).alias("_rows"),
        F.sum(1.0 / F.col("_kc")).alias("_cols"),
        F.sum(1.0 / (r * F.col("_kr"))).alias("_inv_r"),
        F.sum(1.0 / (k * F.col("_kc"))).alias("_inv_c"),
    )
    total = F.col("_n").cast("double")
    # Expected counts of the unobserved cells: (n^2 - sum_observed r*c) / n,
    # exactly 0 when every cell occurs.
    n_exact = F.col("_n").cast(exact)
    unobserved_e = (n_exact * n_exact - F.col("_obs_rc")).cast("double") / total
    plain = F.col("_terms") + unobserved_e
    inv_e = total * F.col("_inv_r") * F.col("_inv_c")
    gap = F.sqrt(F.greatest(plain, F.lit(0.0)) / inv_e)
    yates = F.pow(gap - F.least(F.lit(0.5), gap), 2) * inv_e
    sums = sums.withColumn("n_rows", F.coalesce(F.round("_rows").cast("long"), F.lit(0).cast("long"))).withColumn(
        "n_cols", F.coalesce(F.round("_cols").cast("long"), F.lit(0).cast("long"))
    )
    # A table with fewer than two rows or columns (or no cells) has dof 0.
    dof = (
        F.greatest(F.col("n_rows") - 1, F.lit(0)) * F.greatest(F.col("n_cols") - 1, F.lit(0))
    ).cast("long")
    chi2 = F.when(dof == 0, F.lit(0.0)).when((dof == 1) & F.lit(correction), yates).otherwise(plain)
    return sums.select(
        chi2.alias("chi2"),
        dof.alias("dof"),
        "n_rows",
        "n_cols",
        F.coalesce(F.col("_n").cast("long"), F.lit(0).cast("long")).alias("n"),
    )


def chi_square(
    c: DataFrame,
    row: str = CHANNEL,
    col: str = RESPONSE,
    weight: str = "count",
    alpha: float = 0.05,
    correction: bool = True,
    digits: int | None = None,
) -> DataFrame:
    """The report: ``(chi2, p_value, dof, n_rows, n_cols, n, interpretation,
    summary)``; dof = 0 gives p 1; ``summary`` is the report's text line, its
    numbers in full or with ``digits`` decimals."""

    def text(x: str):
        return F.col(x).cast("string") if digits is None else F.format_string(f"%.{digits}f", F.col(x))

    stat = chi_square_statistic(c, row, col, weight, correction)
    p_value = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(
        chi2_p_value(F.col("chi2"), F.col("dof"))
    )
    stat = stat.withColumn("p_value", p_value)
    return stat.select(
        "chi2",
        "p_value",
        "dof",
        "n_rows",
        "n_cols",
        "n",
        F.when(F.col("p_value") < alpha, F.lit(_with_alpha(REJECT_TEXT, alpha)))
        .otherwise(F.lit(_with_alpha(ACCEPT_TEXT, alpha)))
        .alias("interpretation"),
        # The labels of the reference's report line.
        F.concat(
            F.lit("Chi-square statistic: "), text("chi2"),
            F.lit(", p-value: "), text("p_value"),
            F.lit(", Degrees of freedom: "), F.col("dof").cast("string"),
        ).alias("summary"),
    )
