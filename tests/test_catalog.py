from __future__ import annotations

import pytest

import __spark_entry__ as entry
from ferrule.jobs.catalog import ORACLE_SQL, QUERIES
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_gives_the_rows_of_its_sql(spark, data, con, name):
    same(QUERIES[name](spark, data), con, ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
