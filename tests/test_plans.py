"""Plan properties of every registered query (executed, final adaptive plan)."""

import re
from collections import Counter

import pytest
from helpers import SF001

from redress.plans.registry import QUERIES

# sample_rows reads lineitem for the five smallest ids, for the rows holding
# them and for the keys of those rows (one or two columns each).
MOST_SCANS = {"sample_rows": 5, "sample_records": 5}


@pytest.fixture(scope="module")
def plans(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    out = {}
    for name, q in QUERIES.items():
        df = q(spark, SF001)
        df.collect()  # runs this DataFrame's own plan, so AQE finalises it
        out[name] = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "isFinalPlan=false" not in out[name], name
    return out


def test_no_cartesian_or_nested_loop_join(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_tables_are_scanned_twice_at_most(plans):
    # twice where a default or a top-n is a subquery over the same groups and
    # Spark does not reuse their exchange
    found = {}
    for name, plan in plans.items():
        fresh = re.sub(r"ReusedExchange[^\n]*", "", plan)
        tables = Counter(re.findall(r"Scan parquet [^\n]*?/(\w+)\.parquet\]", fresh))
        if max(tables.values(), default=0) > MOST_SCANS.get(name, 2):
            found[name] = tables
    assert not found


def test_aggregates_are_partial_before_the_shuffle(plans):
    # Every aggregate over shuffled input has a map-side partial stage (a
    # keys-only aggregate, i.e. a map-side distinct, shows no partial_ marker).
    for name, plan in plans.items():
        if re.search(r"(Hash|ObjectHash|Sort)Aggregate", plan) and "Exchange hashpartitioning" in plan:
            assert "partial_" in plan or "functions=[]" in plan, name


def test_no_python_in_any_plan(plans):
    for name, plan in plans.items():
        assert not re.search(r"ArrowEvalPython|BatchEvalPython|InPandas|InArrow", plan), name


def test_broadcast_hint_only_on_the_bounded_id_list(plans):
    # The only hinted broadcast is the at-most-n id list of sample_rows; every
    # other broadcast comes from Spark's size check of a small table.
    for name, plan in plans.items():
        assert ("_cid" in plan) == (name in MOST_SCANS), name
