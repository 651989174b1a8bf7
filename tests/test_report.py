import os
import tempfile

from helpers import SF001

from redress.plans import report
from redress.plans.registry import ISSUE_LABELS, MIN_YEAR, PRODUCT_LABELS, QUERIES


def _rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_report_from_stored_table_equals_view_queries(spark):
    folder = tempfile.mkdtemp(prefix="redress-report-")
    path = report.build_complaints_table(spark, SF001, os.path.join(folder, "complaints"))
    # the parameters of the registered queries
    results = report.run_report(
        report.read_table(spark, path), min_year=MIN_YEAR, top_n=3, top_pairs=10,
        product_labels=PRODUCT_LABELS, issue_labels=ISSUE_LABELS,
    )
    same = [
        "sample_rows", "missing_counts", "product_counts", "product_totals", "product_options", "products",
        "top_issues", "channel_response_totals", "state_counts_for",
        "issue_subissue_lists", "top_issue_subissue", "channel_response_crosstab",
        "expected_counts", "daily_trend", "response_trend", "product_trend_for",
        "top_issue_per_year", "response_composition", "dispute_by_response",
    ]
    for name in same:
        assert _rows(results[name]) == _rows(QUERIES[name](spark, SF001)), name
    stat = results["chi_square_report"].first()
    assert round(stat.chi2, 10) == QUERIES["chi_square_channel_response"](spark, SF001).first().chi2
    assert 0.0 <= stat.p_value <= 1.0
    first_year = results["trend_for_year"].collect()
    assert {r.date_received.year for r in first_year} == {MIN_YEAR}


def test_report_cli_writes_every_result(spark):
    folder = tempfile.mkdtemp(prefix="redress-report-")
    table = report.build_complaints_table(spark, SF001, os.path.join(folder, "complaints"))
    out = os.path.join(folder, "out")
    report.write_report(report.run_report(report.read_table(spark, table), min_year=MIN_YEAR), out)
    written = sorted(os.listdir(out))
    assert written == sorted(report.report_plans())
    assert spark.read.parquet(os.path.join(out, "daily_trend")).count() > 0
