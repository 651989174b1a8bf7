from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from redress.session import get_session  # noqa: E402
from redress.sources.complaints import COMPLAINT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_session(
        "local[*]",
        app_name="redress-tests",
        shuffle_partitions=8,
        conf={"spark.driver.memory": "8g"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def frame(spark):
    """Build a complaints DataFrame from ``complaint(...)`` rows."""

    def build(rows):
        return spark.createDataFrame(rows, COMPLAINT_SCHEMA)

    return build
