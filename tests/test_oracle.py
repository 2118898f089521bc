"""Every registered query against its SQL on the smallest tables."""

import pytest

from fraudwatch.catalog import ORACLES, QUERIES
from tools.compare import compare, tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    count, same, note = compare(spark, con, FOLDER, name)
    assert same, note


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_yields_rows(spark, con, name):
    count, _, _ = compare(spark, con, FOLDER, name)
    assert count > 0


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["n"] for r in rows] == sorted((r["n"] for r in rows), reverse=True)
    assert abs(sum(r["share"] for r in rows) - 100) < 0.5
