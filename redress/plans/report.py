"""The full report: every dashboard result from one complaints table.

The reference runs its twelve start-up queries against one warehouse table.
Here the table is stored once as parquet (``build_complaints_table``), in
a folder on shared storage.  Every
result is then a separate lazy plan over that table: each scans only its one
to three columns, with its filters pushed into the reader.  Writing the table
also cuts the lineage back to the source joins, so a lost executor re-reads
stored files instead of re-running the joins.

Results are returned lazily; ``write_report`` stores each one.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from redress.functions.labels import ISSUE_ABBREVIATIONS, PRODUCT_ABBREVIATIONS, RESPONSES
from redress.operators import association, counts, outcomes, profile, trends
from redress.sources.complaints import read_complaints
from redress.sources.tpch_view import complaints_view


def build_complaints_table(
    spark: SparkSession, sf_dir: str, path: str, mode: str = "overwrite"
) -> str:
    """Store the complaints view over the tables in ``sf_dir`` as parquet
    under ``path`` (shared storage on a cluster).  Returns the path."""
    complaints_view(spark, sf_dir).write.mode(mode).parquet(path)
    return path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return read_complaints(spark, path)


def report_plans(
    min_year: int | None = 2012,
    year: int | None = None,
    window: int = 30,
    top_n: int = 10,
    top_pairs: int = 15,
    alpha: float = 0.05,
    responses: list[str] = RESPONSES,
    product_labels: dict[str, str] = PRODUCT_ABBREVIATIONS,
    issue_labels: dict[str, str] = ISSUE_ABBREVIATIONS,
) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Every result of the dashboard as ``name -> (complaints -> DataFrame)``.

    Defaults are the reference's (cut at 2012, top 10 issues, top 15 pairs,
    alpha 0.05); ``year`` defaults to the first year of the cut trend;
    ``responses`` are the columns of the wide response trend, and the labels
    are the abbreviations of products and issues.
    """
    R = "company_response_to_consumer"

    return {
        "sample_rows": lambda c: profile.sample_rows(c, 5),
        "missing_counts": profile.missing_counts,
        "product_counts": lambda c: counts.product_counts(c, product_labels),
        "product_totals": lambda c: counts.product_counts(c, product_labels, totals=True),
        "product_options": counts.product_options,
        "products": counts.products,
        "product_subproduct_state": counts.product_subproduct_state,
        "product_subproduct_lists": counts.product_subproduct_lists,
        "subproducts_for": counts.subproducts_for,
        "state_counts_for": counts.state_counts_for,
        "issue_counts": counts.issue_counts,
        "issue_subissue_counts": counts.issue_subissue_counts,
        "issue_totals": counts.issue_totals,
        "top_issues": lambda c: counts.top_issues(c, top_n),
        "top_issue_subissue": lambda c: counts.top_issue_subissue(c, top_n, top_pairs, issue_labels),
        "issue_subissue_lists": counts.issue_subissue_lists,
        "subissues_for": counts.subissues_for,
        "channel_response_counts": association.channel_response_counts,
        "channel_response_totals": lambda c: association.channel_response_counts(c, with_totals=True),
        "channel_response_crosstab": association.crosstab,
        "expected_counts": association.expected_counts,
        "chi_square_report": lambda c: association.chi_square(c, alpha=alpha),
        "chi_square_presence": lambda c: association.chi_square(c, weight="presence", alpha=alpha),
        "daily_trend": lambda c: trends.daily_trend(c, window, min_year),
        "trend_for_year": lambda c: trends.trend_for_year(c, year, window, min_year),
        "trend_year_domain": lambda c: trends.trend_year_domain(c, min_year, window),
        "year_marks": lambda c: trends.year_marks(c, min_year, window),
        "response_trend": lambda c: trends.category_trend(c, R, window),
        "response_trend_wide": lambda c: trends.category_trend_wide(c, R, responses),
        "product_trend": lambda c: trends.category_trend(c, "product", window),
        "product_trend_for": lambda c: trends.category_trend_for(c, "product", None, window),
        "top_issue_per_year": trends.top_issue_per_year,
        "response_composition": outcomes.response_composition,
        "dispute_by_response": outcomes.dispute_by_response,
    }


def run_report(complaints: DataFrame, **params) -> dict[str, DataFrame]:
    """All results as lazy DataFrames over ``complaints``; ``params`` as in
    :func:`report_plans` (the test data spans 1995-2001, so it needs
    ``min_year=1996`` rather than the reference's 2012)."""
    return {name: build(complaints) for name, build in report_plans(**params).items()}


def write_report(results: dict[str, DataFrame], out_dir: str, mode: str = "overwrite") -> None:
    """Store every result as parquet under ``out_dir/<name>``."""
    for name, df in results.items():
        df.write.mode(mode).parquet(os.path.join(out_dir, name))


def main(argv: list[str] | None = None) -> None:
    """``python -m redress.plans.report [--source DIR] --table DIR --out DIR``

    Builds the complaints table at ``--table`` from the driver-style tables in
    ``--source`` (or reads the one that is there) and stores every result.
    """
    import argparse

    from redress.session import get_session

    parser = argparse.ArgumentParser(description=main.__doc__)
    parser.add_argument("--source", help="folder of lineitem/orders/... parquet tables")
    parser.add_argument("--table", required=True, help="the complaints parquet table")
    parser.add_argument("--out", required=True, help="folder for the results")
    parser.add_argument("--min-year", type=int, default=2012)
    parser.add_argument("--master", default=None)
    args = parser.parse_args(argv)
    spark = get_session(args.master)
    if args.source:
        build_complaints_table(spark, args.source, args.table)
    write_report(run_report(read_table(spark, args.table), min_year=args.min_year), args.out)


if __name__ == "__main__":
    main()
