"""Every query with SQL must equal it on the same tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom import queries as base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def norm(rows, names):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows), [names[i] for i in at]


@pytest.mark.parametrize("name", sorted(base.oracle_sql()))
def test_equal(spark, con, name):
    got = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    want = norm(cur.fetchall(), [c[0] for c in cur.description])
    rows = norm([tuple(r) for r in got.collect()], got.columns)
    assert rows[1] == want[1]
    assert rows[0] == want[0]


def test_entry(spark):
    assert entry.entry(spark).count() == 50
