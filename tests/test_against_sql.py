"""Every query against its own SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from fleetlens.plans.check import compare, database

QUERIES = contract.queries()
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(small):
    return database(small)


def test_every_statement_has_its_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_rows_agree(spark, small, con, key):
    assert compare(QUERIES[key](spark, small), con, SQL[key]) == []


def test_entry(spark):
    row = contract.entry(spark).groupBy().sum("total", "valid", "invalid", "no_context").first()
    total, valid, invalid, no_context = row
    assert total == valid + invalid + no_context > 0
