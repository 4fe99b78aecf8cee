from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract
from millrace import llm

FOLDER = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = list(contract.queries())
    for n in range(1, 11):
        assert [x for x in names if x.startswith(f"op{n}_")], n
    assert "pipeline" in names


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_matches_sql(spark, name):
    con = oracle.connect(FOLDER)
    ours = llm.QUERIES[name](spark, FOLDER).toArrow()
    assert oracle.difference(ours, con.execute(llm.SQL[name]).to_arrow_table()) is None
    con.close()
