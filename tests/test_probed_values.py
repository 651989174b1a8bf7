"""Values probed on the view at sf0.01 when the blueprint was written
"""

import pytest
from helpers import SF01
from pyspark.sql import functions as F

from redress.operators import association, trends
from redress.sources.tpch_view import complaints_view

CH, RESP = "submitted_via", "company_response_to_consumer"


@pytest.fixture(scope="module")
def view(spark):
    cols = ["date_received", "state", "subproduct", "subissue", "consumer_disputed", CH, RESP]
    return complaints_view(spark, SF01, cols)


def test_view_row_count_and_days(spark, view):
    assert view.count() == 60_000
    assert view.select("date_received").distinct().count() == 2_399


def test_presence_chi_square_on_discriminating_inputs(view):
    one = view.where((F.col("state") == "NATION_1") & (F.col("subproduct") == "Brand#1"))
    got = association.chi_square_statistic(one, weight="presence").first()
    assert abs(got.chi2 - 5.593333) < 1e-6
    day = view.where(F.col("date_received") == F.lit("1998-10-03").cast("date"))
    got = association.chi_square_statistic(day, weight="presence").first()
    assert abs(got.chi2 - 9.177778) < 1e-6
    whole = association.chi_square_statistic(view, weight="presence").first()
    assert whole.chi2 == 0.0  # every (channel, response) pair occurs


def test_count_chi_square_on_whole_view(view):
    got = association.chi_square(view).first()
    assert abs(got.chi2 - 17.078334) < 1e-6 and got.dof == 20
    assert abs(got.p_value - 0.648) < 5e-4
    # 4 sub-issues x 2 dispute values, 4 of 8 cells filled: each sub-issue
    # fixes the dispute flag, so chi2 = n * (min(R, C) - 1) = n.
    pair = association.chi_square(view, "subissue", "consumer_disputed").first()
    assert (pair.n_rows, pair.n_cols, pair.dof) == (4, 2, 3)
    assert pair.chi2 == pair.n == 40_074 and pair.p_value < 0.05


def test_daily_trend_sizes(view):
    full = trends.daily_trend(view)
    assert full.count() == 2_399
    assert full.where(F.col("monthly_mva").isNotNull()).count() == 2_370
    cut = trends.daily_trend(view, min_year=1996)
    assert cut.count() == 2_034 and cut.where(F.col("monthly_mva").isNull()).count() == 0
