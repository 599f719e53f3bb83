"""Every registered query next to its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from casebook.plans import catalog
from tools.check import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    rows, verdict = compare(spark, con, FOLDER, catalog.QUERIES[name], catalog.SQL.get(name))
    assert verdict in ("ok", "rows only"), verdict


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "source", "hits", "total", "percent"]
    assert df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
