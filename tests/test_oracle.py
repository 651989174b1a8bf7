"""Every registered query against its DuckDB oracle at sf0.01 (exact values)."""

import os
import sys

import duckdb
import pytest
from helpers import SF01

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from compare import TABLES, compare  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, con, name, monkeypatch):
    monkeypatch.setenv("EXACT", "1")
    line = compare(spark, con, name, SF01)
    assert " OK " in line, line


def test_every_query_runs_on_smoke_data(spark):
    for name, q in entry.queries().items():
        df = q(spark, "/root/testdata/sf0.001")
        assert df.columns, name
    assert entry.entry(spark).count() > 0
