from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vidmatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    # Few, small tasks: the frames of the tests have a handful of rows.
    session = build_session("tests", "local[4]", 2, {"spark.default.parallelism": "2"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of one expression."""

    def run(expression):
        return spark.range(1).select(expression.alias("v")).first()["v"]

    return run
