import datetime as dt
import random

import numpy as np
import pandas as pd
from helpers import complaint, day

from redress.operators import trends


def _daily_rows(counts_by_day):
    rows = []
    for i, n in counts_by_day.items():
        rows += [complaint(date_received=day(i))] * n
    return rows


def test_daily_trend_matches_pandas_rolling(frame):
    rng = random.Random(7)
    present = [i for i in range(80) if rng.random() > 0.2]  # gaps: rows, not days
    by_day = {i: rng.randint(1, 6) for i in present}
    got = trends.daily_trend(frame(_daily_rows(by_day))).toPandas().sort_values("date_received")
    s = pd.Series(by_day).sort_index()
    want = s.rolling(window=30).mean()
    assert list(got["count"]) == list(s.values)
    np.testing.assert_allclose(got["monthly_mva"].astype(float).values, want.values, equal_nan=True)
    assert got["monthly_mva"].isna().sum() == 29


def test_daily_trend_short_series_all_null(frame):
    got = trends.daily_trend(frame(_daily_rows({i: 1 for i in range(10)}))).collect()
    assert len(got) == 10 and all(r.monthly_mva is None for r in got)


def test_year_cut_applies_after_smoothing(frame):
    # 40 days in 2019-12 .. 2020-01: the first 2020 days carry 2019's rows.
    start = dt.date(2019, 12, 1)
    rows = []
    for i in range(60):
        rows += [complaint(date_received=start + dt.timedelta(days=i))] * (i % 3 + 1)
    c = frame(rows)
    full = {r.date_received: r.monthly_mva for r in trends.daily_trend(c).collect()}
    cut = {r.date_received: r.monthly_mva for r in trends.daily_trend(c, min_year=2020).collect()}
    assert min(cut) == dt.date(2020, 1, 1)
    assert all(cut[d] == full[d] for d in cut)
    assert cut[dt.date(2020, 1, 1)] is not None  # window reaches back into 2019
    one_year = trends.trend_for_year(c, 2020, min_year=2020).collect()
    assert {r.date_received for r in one_year} == set(cut)
    assert trends.trend_for_year(c, 2019, min_year=2020).count() == 0


def test_null_date_is_first_row_of_window(frame):
    rows = _daily_rows({i: 1 for i in range(30)}) + [complaint(date_received=None)] * 4
    got = trends.daily_trend(frame(rows)).collect()
    by = {r.date_received: r for r in got}
    assert by[None]["count"] == 4
    # the 29th dated day completes a 30-row window that includes the null row
    assert by[day(28)].monthly_mva == (4 + 29) / 30
    assert trends.daily_trend(frame(rows), min_year=1900).where("date_received IS NULL").count() == 0


def test_year_domain(frame):
    rows = [complaint(date_received=dt.date(y, 3, 1)) for y in (2018, 2019, 2021)]
    got = sorted((r.year, r.mark, r.year_min, r.year_max) for r in trends.trend_year_domain(frame(rows), 2019).collect())
    assert got == [(2019, "2019", 2019, 2021), (2021, "2021", 2019, 2021)]


def _category_rows(rng):
    rows, records = [], []
    cats = ["Closed", "Closed with explanation", "In progress", "Zeta, with comma"]
    for i in range(70):
        if rng.random() < 0.15:
            continue  # a day on which nothing happened: not on the axis
        for k in cats:
            if rng.random() < 0.5:
                n = rng.randint(1, 4)
                rows += [complaint(date_received=day(i), company_response_to_consumer=k)] * n
                records.append((day(i), k, n))
        rows.append(complaint(date_received=day(i), company_response_to_consumer=None))
    # a day with only a null category: not on the axis
    rows.append(complaint(date_received=day(200), company_response_to_consumer=None))
    return rows, records


def test_category_trend_matches_pandas_pivot_rolling(frame):
    rows, records = _category_rows(random.Random(3))
    cat = "company_response_to_consumer"
    got = trends.category_trend(frame(rows), cat).toPandas()
    pdf = pd.DataFrame(records, columns=["date_received", cat, "count"])
    wide = pdf.pivot(index="date_received", columns=cat, values="count").fillna(0)
    mva = wide.rolling(window=30).mean()
    assert len(got) == wide.shape[0] * wide.shape[1]
    g = got.set_index(["date_received", cat])
    for d in wide.index:
        for k in wide.columns:
            assert g.loc[(d, k), "count"] == wide.loc[d, k]
            want = mva.loc[d, k]
            have = g.loc[(d, k), "monthly_mva"]
            assert (pd.isna(want) and pd.isna(have)) or abs(want - have) < 1e-12
    wide_got = trends.category_trend_wide(frame(rows), cat).toPandas().set_index("date_received")
    assert sorted(wide_got.columns) == sorted(wide.columns)
    for k in wide.columns:
        assert list(wide_got.loc[wide.index, k]) == list(wide[k].astype(int))


def test_category_trend_for_defaults_to_first_category(frame):
    rows, _ = _category_rows(random.Random(5))
    cat = "company_response_to_consumer"
    got = trends.category_trend_for(frame(rows), cat).select(cat).distinct().collect()
    assert [r[0] for r in got] == ["Closed"]
    one = trends.category_trend_for(frame(rows), cat, "In progress").toPandas()
    full = trends.category_trend(frame(rows), cat).toPandas()
    assert len(one) == (full[cat] == "In progress").sum()


def test_top_issue_per_year(frame):
    rows = (
        [complaint(date_received=dt.date(2019, 1, 1), issue="b")] * 3
        + [complaint(date_received=dt.date(2019, 1, 2), issue="a")] * 3  # tie: smaller label
        + [complaint(date_received=dt.date(2019, 1, 2), issue="c")] * 1
        + [complaint(date_received=dt.date(2020, 1, 1), issue=None)] * 5  # labelled, real count
        + [complaint(date_received=dt.date(2020, 1, 1), issue="d")] * 4
        + [complaint(date_received=None, issue="e")] * 9  # null year: dropped
    )
    got = sorted((r.year, r.issue, r["count"]) for r in trends.top_issue_per_year(frame(rows)).collect())
    assert got == [(2019, "a", 3), (2020, "Unknown", 5)]


def test_wide_with_given_categories_needs_no_discovery(frame):
    rows, _ = _category_rows(random.Random(9))
    cat = "company_response_to_consumer"
    given = ["Closed", "In progress", "Not in data"]
    wide = trends.category_trend_wide(frame(rows), cat, categories=given)
    assert wide.columns == ["date_received", *given]
    found = trends.category_trend_wide(frame(rows), cat).toPandas().set_index("date_received")
    got = wide.toPandas().set_index("date_received")
    assert (got["Not in data"] == 0).all()
    for k in ("Closed", "In progress"):
        assert list(got.loc[found.index, k]) == list(found[k])


def test_default_year_and_marks(frame):
    rows = [complaint(date_received=dt.date(y, 3, d)) for y in (2011, 2012, 2014) for d in (1, 2)]
    c = frame([*rows, complaint(date_received=None)])
    years = {r.date_received.year for r in trends.trend_for_year(c, min_year=2012).collect()}
    assert years == {2012}
    assert trends.year_marks(c, 2012).first().marks == {"2012": "2012", "2014": "2014"}
    assert trends.year_marks(c, 2020).first().marks == {}


def test_leading_issue_with_the_years_total(frame):
    rows = [complaint(date_received=day(0), issue=x) for x in ("a", "a", "b", None)] + [complaint(date_received=day(400), issue=None)]
    got = [tuple(r) for r in trends.top_issue_per_year(frame(rows), with_totals=True).orderBy("year").collect()]
    assert got == [(2020, "a", 2, 4, 0.5), (2021, "Unknown", 1, 1, 1.0)]
