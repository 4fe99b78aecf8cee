"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract
from millrace import plans

FOLDER = "/root/testdata/sf0.001"
plans.load_all()
QUERIES, SQL = plans.QUERIES, plans.SQL


@pytest.fixture(scope="module")
def con():
    connection = oracle.connect(FOLDER)
    yield connection
    connection.close()


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    ours = QUERIES[name](spark, FOLDER).toArrow()
    theirs = con.execute(SQL[name]).to_arrow_table()
    assert oracle.difference(ours, theirs) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 5
