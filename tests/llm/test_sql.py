"""Queries with SQL equal it on the same tables."""

import glob
import os

import duckdb
import pytest

from sparkloom.llm import queries as Q
from tests.test_oracle import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equal(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = Q.queries()[name](spark, SF)
    cur = con.execute(Q.oracle_sql()[name])
    want = norm(cur.fetchall(), [c[0] for c in cur.description])
    assert norm([tuple(r) for r in got.collect()], got.columns) == (want[0], want[1])
