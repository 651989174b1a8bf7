"""Random complaint frames: every counting operator against pandas written
the way the reference computes (SQL COUNT semantics, then pandas)."""

import datetime as dt

import pandas as pd
from helpers import complaint
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from redress.operators import association, counts, outcomes, trends
from redress.sources.complaints import COMPLAINT_SCHEMA

RESP = "company_response_to_consumer"
CLOSED = ["Closed", "Closed with explanation"]

row = st.builds(
    lambda p, s, stt, i, si, ch, r, d, day: complaint(
        product=p, subproduct=s, state=stt, issue=i, subissue=si, submitted_via=ch,
        company_response_to_consumer=r, consumer_disputed=d,
        date_received=None if day is None else dt.date(2019, 12, 25) + dt.timedelta(days=day),
    ),
    st.sampled_from([None, "P1", "P2", "P3"]),
    st.sampled_from([None, "s1", "s2"]),
    st.sampled_from([None, "CA", "TX"]),
    st.sampled_from([None, "Unknown", "I1", "I2", "I3"]),
    st.sampled_from([None, "u1", "u2"]),
    st.sampled_from([None, "Web", "Phone", "Fax"]),
    st.sampled_from([None, "Closed", "Closed with explanation", "In progress"]),
    st.sampled_from([None, True, False]),
    st.one_of(st.none(), st.integers(0, 14)),
)


def _pdf(rows):
    names = [f.name for f in COMPLAINT_SCHEMA.fields]
    return pd.DataFrame(rows, columns=names).astype(object)


def _key(v):
    return "\x00" if v is None or (isinstance(v, float) and pd.isna(v)) else v


def _norm(d):
    return {tuple(_key(x) for x in (k if isinstance(k, tuple) else (k,))): v for k, v in d.items()}


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=60))
def test_counts_match_pandas(spark, rows):
    c = spark.createDataFrame(rows, COMPLAINT_SCHEMA)
    pdf = _pdf(rows)

    # A1: WHERE subproduct IS NOT NULL GROUP BY product, COUNT(product)
    want = pdf[pdf.subproduct.notna()].groupby("product", dropna=False)["product"].count().to_dict()
    got = {r.product: r.Counts_Complaints for r in counts.product_counts(c).collect()}
    assert _norm(got) == _norm(want)

    # A2: COUNT(state) per (product, subproduct, state), subproduct present
    sub = pdf[pdf.subproduct.notna()]
    want = sub.groupby(["product", "subproduct", "state"], dropna=False)["state"].count().to_dict()
    got = {(r.product, r.subproduct, r.state): r.Counts_Complaints for r in counts.product_subproduct_state(c).collect()}
    assert _norm(got) == _norm(want)

    # A13: sub-products per product in first-appearance order over the counts
    # sorted by count descending (ties pinned: product, sub-product, state).
    pss = sub.groupby(["product", "subproduct", "state"], dropna=False)["state"].count().reset_index(name="n")
    pss = pss.assign(_st=pss.state.map(lambda x: "" if pd.isna(x) else "~" + x))
    pss = pss.sort_values(["n", "product", "subproduct", "_st"], ascending=[False, True, True, True], na_position="first")
    want = {}
    for p, sp in zip(pss["product"], pss["subproduct"]):
        if pd.notna(p) and sp not in want.setdefault(p, []):
            want[p].append(sp)
    got = {}
    for r in sorted(counts.product_subproduct_lists(c).collect(), key=lambda r: (r.product, r.position)):
        got.setdefault(r.product, []).append(r.subproduct)
    assert got == want

    # A4: labels, grouped by label, COUNT(issue)
    lab = pdf.assign(li=pdf.issue.fillna("Unknown"), ls=pdf.subissue.fillna("Unknown"))
    want = lab.groupby(["li", "ls"])["issue"].count().to_dict()
    got = {(r.issue, r.subissue): r["count"] for r in counts.issue_subissue_counts(c).collect()}
    assert _norm(got) == _norm(want)
    # A12 re-aggregated == A3
    want3 = lab.groupby("li")["issue"].count().to_dict()
    got3 = {r.issue: r["count"] for r in counts.issue_counts(c).collect()}
    got12 = {r.issue: r["count"] for r in counts.issue_totals(c).collect()}
    assert _norm(got3) == _norm(want3) == _norm(got12)

    # A13 + J4: sub-issues per issue in first-appearance order over the pairs
    # sorted by count descending, issues reindexed by their totals.
    pairs = lab.groupby(["li", "ls"])["issue"].count().reset_index(name="n")
    pairs = pairs.sort_values(["n", "li", "ls"], ascending=[False, True, True])
    totals = pairs.groupby("li")["n"].sum().reset_index().sort_values(["n", "li"], ascending=[False, True])
    issues = list(totals.li)
    want = {i: [] for i in issues}
    for i, x in zip(pairs.li, pairs.ls):
        want[i].append(x)
    rows = sorted(counts.issue_subissue_lists(c).collect(), key=lambda r: (r.issue_position, r.position))
    got = {}
    for r in rows:
        got.setdefault(r.issue, []).append(r.subissue)
    assert list(got) == issues and got == want

    # T5 + T6 + P5: the 3 largest pairs among the 2 largest issues (ties pinned)
    top = set(totals.li.head(2))
    want = [tuple(x) for x in pairs[pairs.li.isin(top)].head(3)[["li", "ls", "n"]].itertuples(index=False)]
    got = [(r.issue, r.subissue, r["count"]) for r in counts.top_issue_subissue(c, 2, 3).collect()]
    assert sorted(got) == sorted(want)

    # A5: COUNT(*) per (channel, response), nulls as groups
    want = pdf.groupby(["submitted_via", RESP], dropna=False).size().to_dict()
    got = {(r.submitted_via, r[RESP]): r.Count_Response for r in association.channel_response_counts(c).collect()}
    assert _norm(got) == _norm(want)

    # A17 weighted by complaints: pd.crosstab on the raw rows, dense, nulls dropped
    both = pdf[pdf.submitted_via.notna() & pdf[RESP].notna()]
    if len(both):
        ct = pd.crosstab(both.submitted_via, both[RESP])
        want = {(a, b): int(ct.loc[a, b]) for a in ct.index for b in ct.columns}
    else:
        want = {}
    got = {(r.submitted_via, r[RESP]): r.n for r in association.crosstab(c).collect()}
    assert got == want

    # A11 + A22: chosen responses, dispute known, shares within response
    f = pdf[pdf[RESP].isin(CLOSED) & pdf.consumer_disputed.notna()]
    g = f.groupby([RESP, "consumer_disputed"]).size()
    want = {(k[0], "True" if k[1] else "False"): (int(v), v / g[k[0]].sum()) for k, v in g.items()}
    got = {(r.Response, r.Dispute): (r.Count_response, r.share) for r in outcomes.dispute_by_response(c, CLOSED).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-12

    # A9 + W3: COUNT(*) per (year, issue), fillna after, idxmax (ties pinned to the smaller label)
    years = pdf.assign(year=pdf.date_received.map(lambda d: None if d is None else d.year))
    g = years.groupby(["year", "issue"], dropna=False).size().reset_index(name="n")
    g = g[g.year.notna()].assign(issue=lambda x: x.issue.fillna("Unknown"))
    g = g.sort_values(["year", "n", "issue"], ascending=[True, False, True])
    want = {int(y): (grp.iloc[0].issue, int(grp.iloc[0].n)) for y, grp in g.groupby("year")}
    got = {r.year: (r.issue, r["count"]) for r in trends.top_issue_per_year(c).collect()}
    assert got == want


cell = st.tuples(st.integers(0, 45), st.sampled_from(["A", "B", "C, d", "É"]), st.integers(1, 5))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(cell, min_size=1, max_size=80))
def test_category_trend_matches_pandas_pivot_rolling(spark, cells):
    rows = []
    for d, k, n in cells:
        rows += [complaint(date_received=dt.date(2021, 1, 1) + dt.timedelta(days=d),
                           company_response_to_consumer=k)] * n
    c = spark.createDataFrame(rows, COMPLAINT_SCHEMA)
    pdf = _pdf(rows)[["date_received", RESP]]
    per_day = pdf.groupby(["date_received", RESP]).size().reset_index(name="count")
    wide = per_day.pivot(index="date_received", columns=RESP, values="count").fillna(0)
    mva = wide.rolling(window=30).mean()
    got = trends.category_trend(c, RESP).collect()
    assert len(got) == wide.shape[0] * wide.shape[1]
    for r in got:
        assert r["count"] == wide.loc[r.date_received, r[RESP]]
        want = mva.loc[r.date_received, r[RESP]]
        assert (pd.isna(want) and r.monthly_mva is None) or abs(want - r.monthly_mva) < 1e-12


table = st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=4), min_size=1, max_size=4).map(
    lambda rows: [r + [0] * (max(map(len, rows)) - len(r)) for r in rows]
)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(table)
def test_chi_square_matches_textbook_on_random_tables(spark, obs):
    import numpy as np

    from helpers import chi2_sf

    rows = []
    for i, line in enumerate(obs):
        for j, n in enumerate(line):
            rows += [complaint(submitted_via=f"r{i}", company_response_to_consumer=f"c{j}")] * n
    if not rows:
        return
    got = association.chi_square(spark.createDataFrame(rows, COMPLAINT_SCHEMA)).first()
    o = np.array(obs, dtype=float)
    o = o[o.sum(1) > 0][:, o.sum(0) > 0]  # the table has only observed row / column keys
    n = o.sum()
    e = np.outer(o.sum(1), o.sum(0)) / n
    dof = (o.shape[0] - 1) * (o.shape[1] - 1)
    assert got.dof == dof and got.n == n
    if dof == 0:
        assert (got.chi2, got.p_value) == (0.0, 1.0)
        return
    oc = o + (np.minimum(0.5, np.abs(e - o)) * np.sign(e - o) if dof == 1 else 0)
    want = float(((oc - e) ** 2 / e).sum())
    assert abs(got.chi2 - want) <= 1e-9 * max(1.0, want)
    assert abs(got.p_value - chi2_sf(want, dof)) <= 1e-9
