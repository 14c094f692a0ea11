"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points
import check

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", list(entry_points.queries()))
def test_query(spark, con, name):
    fn = entry_points.queries()[name]
    ok, message, _ = check.compare(spark, con, FOLDER, name, fn, entry_points.oracle_sql().get(name))
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    rows = df.collect()
    assert [r["holdout_set"] for r in rows] == sorted(r["holdout_set"] for r in rows)
    assert len(rows) > 0
