"""Places of rows in the display order."""

from pyspark.sql import functions as F

from redress.operators.order import with_position


def test_places_over_many_ranges(spark):
    rows = [(i * 7919 % 1000, f"k{i % 13}" if i % 5 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "n int, k string").repartition(11)
    got = with_position(df, F.desc("n"))
    found = got.collect()
    assert [r.position for r in sorted(found, key=lambda r: r.position)] == list(range(1, 3001))
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    assert [(r.n, r.k) for r in sorted(found, key=lambda r: r.position)] == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "_n" in plan  # over one row per range


def test_empty_and_equal_rows(spark):
    df = spark.createDataFrame([], "n int")
    assert with_position(df, F.asc("n")).collect() == []
    same = spark.createDataFrame([(1,)] * 5, "n int")
    assert sorted(r.position for r in with_position(same).collect()) == [1, 2, 3, 4, 5]
