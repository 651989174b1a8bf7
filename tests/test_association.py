import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import chi2_sf, complaint
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest

from redress.operators import association

CH, RESP = "submitted_via", "company_response_to_consumer"


def _table(frame, cells):
    rows = []
    for (a, b), n in cells.items():
        rows += [complaint(submitted_via=a, company_response_to_consumer=b)] * n
    return frame(rows)


def _numpy_chi2(obs, correction=True):
    obs = np.asarray(obs, dtype=float)
    n = obs.sum()
    e = np.outer(obs.sum(1), obs.sum(0)) / n
    dof = (obs.shape[0] - 1) * (obs.shape[1] - 1)
    if dof == 0:
        return 0.0, 1.0, 0, e
    o = obs
    if dof == 1 and correction:
        d = e - o
        o = o + np.minimum(0.5, np.abs(d)) * np.sign(d)
    chi2 = float(((o - e) ** 2 / e).sum())
    return chi2, chi2_sf(chi2, dof), dof, e


def test_chi2_sf_known_values():
    assert chi2_sf(0.0, 3) == 1.0
    assert chi2_sf(5.0, 0) == 1.0
    assert abs(chi2_sf(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(chi2_sf(18.307038053275146, 10) - 0.05) < 1e-12
    for x in (0.1, 1.0, 7.5, 40.0, 400.0):
        assert abs(chi2_sf(x, 2) - math.exp(-x / 2)) < 1e-13 * max(1, math.exp(-x / 2)) + 1e-300
        assert abs(chi2_sf(x, 1) - math.erfc(math.sqrt(x / 2))) < 1e-12


def test_p_value_column_equals_the_scalar_form(spark):
    from redress.functions.stats import chi2_p_value

    rows = [(x, k) for k in (0, 1, 2, 3, 4, 7, 10, 31, 100, 999, 5000) for x in (0.0, 1e-9, 0.3, 1.0, 9.5, 40.0, 99.0, 400.0, 4900.0, 5200.0)]
    rows += [(None, 3), (2.0, None), (float("nan"), 2)]
    df = spark.createDataFrame(rows, "x double, k int")
    for r in df.select("x", "k", chi2_p_value(F.col("x"), F.col("k")).alias("p")).collect():
        want = chi2_sf(r.x, r.k)
        assert (math.isnan(want) and math.isnan(r.p)) or abs(r.p - want) <= 1e-11 * max(want, 1e-3) + 1e-300, r


def test_chi_square_matches_spark_ml_on_rows(spark, frame):
    rng = random.Random(11)
    channels, responses = ["Web", "Phone", "Fax", "Mail"], ["Closed", "Explained", "Relief"]
    cells = {(a, b): rng.randint(1, 40) for a in channels for b in responses}
    cells[("Fax", "Relief")] = 0  # an empty cell
    cells = {k: v for k, v in cells.items() if v}
    c = _table(frame, cells)
    got = association.chi_square(c).first()
    # Spark ML on the raw rows (string-indexed features)
    idx = StringIndexer(inputCols=[CH, RESP], outputCols=["a", "b"]).fit(c).transform(c)
    vec = VectorAssembler(inputCols=["a"], outputCol="f").transform(idx)
    ml = ChiSquareTest.test(vec, "f", "b").first()
    assert got.dof == ml.degreesOfFreedom[0] == 6
    assert abs(got.chi2 - ml.statistics[0]) < 1e-9 * ml.statistics[0]
    assert abs(got.p_value - ml.pValues[0]) < 1e-9
    obs = [[cells.get((a, b), 0) for b in responses] for a in channels]
    chi2, p, dof, _ = _numpy_chi2(obs)
    assert abs(got.chi2 - chi2) < 1e-9 and abs(got.p_value - p) < 1e-12
    assert got.interpretation.startswith("The p-value is " + ("less" if p < 0.05 else "greater"))


def test_chi_square_yates_on_2x2(frame):
    cells = {("Web", "Closed"): 12, ("Web", "Relief"): 3, ("Phone", "Closed"): 5, ("Phone", "Relief"): 9}
    got = association.chi_square(_table(frame, cells)).first()
    chi2, p, dof, _ = _numpy_chi2([[12, 3], [5, 9]])
    assert got.dof == 1 and abs(got.chi2 - chi2) < 1e-12 and abs(got.p_value - p) < 1e-12
    plain = association.chi_square(_table(frame, cells), correction=False).first()
    chi2_plain, _, _, _ = _numpy_chi2([[12, 3], [5, 9]], correction=False)
    assert abs(plain.chi2 - chi2_plain) < 1e-12 and plain.chi2 > got.chi2


def test_chi_square_yates_with_empty_cell(frame):
    cells = {("Web", "Closed"): 7, ("Phone", "Closed"): 2, ("Phone", "Relief"): 6}
    got = association.chi_square(_table(frame, cells)).first()
    chi2, p, _, _ = _numpy_chi2([[7, 0], [2, 6]])
    assert abs(got.chi2 - chi2) < 1e-12 and abs(got.p_value - p) < 1e-12


def test_chi_square_dof_zero(frame):
    cells = {("Web", "Closed"): 3, ("Web", "Relief"): 5}
    got = association.chi_square(_table(frame, cells)).first()
    assert (got.chi2, got.p_value, got.dof) == (0.0, 1.0, 0)


def test_presence_weight_counts_pairs(frame):
    cells = {("Web", "Closed"): 50, ("Web", "Relief"): 1, ("Phone", "Closed"): 2,
             ("Fax", "Relief"): 7, ("Fax", "Other"): 1}
    got = association.chi_square(_table(frame, cells), weight="presence").first()
    chi2, p, dof, _ = _numpy_chi2([[1, 1, 0], [1, 0, 0], [0, 1, 1]])
    assert got.n == 5 and got.dof == dof and abs(got.chi2 - chi2) < 1e-12
    with pytest.raises(ValueError):
        association.chi_square(_table(frame, cells), weight="rows")


def test_nulls_dropped_from_table_but_kept_in_counts(frame):
    cells = {("Web", "Closed"): 2, (None, "Closed"): 3, ("Web", None): 4}
    c = _table(frame, cells)
    counts = {(r[CH], r[RESP]): r.Count_Response for r in association.channel_response_counts(c).collect()}
    assert counts == cells
    table = association.crosstab(c).collect()
    assert [(r[CH], r[RESP], r.n) for r in table] == [("Web", "Closed", 2)]


def test_crosstab_dense_and_expected_margins(frame):
    cells = {("Web", "Closed"): 4, ("Web", "Relief"): 1, ("Phone", "Closed"): 2, ("Fax", "Other"): 3}
    c = _table(frame, cells)
    dense = {(r[CH], r[RESP]): r.n for r in association.crosstab(c).collect()}
    assert len(dense) == 9 and dense[("Fax", "Closed")] == 0 and dense[("Web", "Closed")] == 4
    wide = {r[CH]: r.asDict() for r in association.crosstab_wide(c).collect()}
    assert wide["Fax"]["Closed"] == 0 and wide["Web"]["Relief"] == 1
    exp = association.expected_counts(c).toPandas()
    obs = exp.pivot(index=CH, columns=RESP, values="observed")
    e = exp.pivot(index=CH, columns=RESP, values="expected")
    np.testing.assert_allclose(e.sum(1), obs.sum(1))
    np.testing.assert_allclose(e.sum(0), obs.sum(0))
    _, _, _, want = _numpy_chi2(obs.values)
    np.testing.assert_allclose(e.values, want)


def test_empty_and_single_row_tables(frame):
    empty = association.chi_square(_table(frame, {(None, "Closed"): 2})).first()
    assert (empty.chi2, empty.p_value, empty.dof, empty.n) == (0.0, 1.0, 0, 0)
    one = association.chi_square(_table(frame, {("Web", "Closed"): 2, ("Web", "Relief"): 1})).first()
    assert (one.chi2, one.p_value, one.dof, one.n) == (0.0, 1.0, 0, 3)
    assert association.crosstab(_table(frame, {(None, "Closed"): 2})).count() == 0


def test_totals_and_summary_line(frame):
    cells = {("Web", "Closed"): 4, ("Web", "Relief"): 1, ("Phone", "Closed"): 2}
    c = _table(frame, cells)
    got = {(r[CH], r[RESP]): r.total for r in association.channel_response_counts(c, with_totals=True).collect()}
    assert got == {("Web", "Closed"): 5, ("Web", "Relief"): 5, ("Phone", "Closed"): 2}
    rep = association.chi_square(c).first()
    assert rep.summary.startswith(f"Chi-square statistic: {rep.chi2}, p-value: ")
    assert rep.summary.endswith(f"Degrees of freedom: {rep.dof}")


def test_crosstab_wide_with_given_columns(frame):
    cells = {("Web", "Closed"): 4, ("Web", "Relief"): 1, ("Phone", "Closed"): 2}
    wide = association.crosstab_wide(_table(frame, cells), columns=["Closed", "Relief", "Other"])
    got = {r[CH]: (r.Closed, r.Relief, r.Other) for r in wide.collect()}
    assert got == {"Web": (4, 1, 0), "Phone": (2, 0, 0)}
