"""Every query against its SQL, on the smallest tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import check  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from pairloom.plans.registry import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    _, rows, verdict = check.compare(spark, con, name, SF_DIR)
    assert verdict.startswith(("ok", "rows")), verdict
    assert rows > 0


def test_entry(spark):
    row = entry.entry(spark).first()
    assert row.n_queries == 500 and 0.3 < row.accuracy < 1.0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
