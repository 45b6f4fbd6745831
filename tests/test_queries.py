"""Every registered query against its SQL, on whole tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
ORACLES = entry.oracle_sql()
ROWS_ONLY = sorted(set(entry.queries()) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert compare(con, entry.queries()[name](spark, SF), ORACLES[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_has_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
