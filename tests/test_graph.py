"""Graph kernels against plain walks."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom.operators import graph as G
from sparkloom.util import Scratch


def plain(edges):
    """Strongly connected components of two nodes or more, as (least node, node)."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    far = {a: reach(a) for a in out}
    mates = {a: {b for b in far[a] if a in far.get(b, ())} | {a} for a in out}
    return sorted((min(m), a) for a, m in mates.items() if len(m) > 1)


CASES = {
    "none": [],
    "loop on itself": [("a", "a"), ("a", "b")],
    "path": [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)],
    "ring with tails": [("b", "c"), ("c", "d"), ("d", "b"), ("a", "b"), ("d", "e"), ("e", "f")],
    "least node above the cycles": [("a", "d"), ("d", "e"), ("e", "d"), ("e", "b"), ("b", "c"), ("c", "b"), ("b", "f"), ("f", "a"), ("x", "d"), ("c", "g"), ("g", "h"), ("h", "g")],
    "cycle below a cycle": [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e"), ("e", "f"), ("f", "e")],
    "random": [(f"n{x:02}", f"n{y:02}") for r in [random.Random(3)] for x, y in ((r.randrange(30), r.randrange(30)) for _ in range(45))],
}


@pytest.mark.parametrize("case", CASES)
def test_cycles(spark, case):
    edges = spark.createDataFrame(CASES[case], "src string, tgt string")
    assert sorted(tuple(r) for r in G.cycles(edges, Scratch(spark, "t")).collect()) == plain(CASES[case])


def test_live_long_path(spark):
    """More rounds than one table of new rows holds."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "src long, tgt long")
    roots = spark.createDataFrame([(0,), (0,), (60,)], "node long")
    assert sorted(r.node for r in G.live(roots, edges, Scratch(spark, "t")).collect()) == [*range(41), 60]


SHAPES = {
    "ring": [(k, (k + 1) % 9) for k in range(9)],
    "ring with trees above and below": [(k, (k + 1) % 5) for k in range(5)] + [(2, 10), (10, 11), (10, 12), (20, 21), (21, 3), (22, 21)],
    "two rings joined by a chain": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (7, 5)],
    "rings that share a node": [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)],
    "loop back from a branch": [(0, 1), (1, 2), (2, 3), (3, 0), (1, 4), (4, 5), (2, 6), (6, 1), (9, 0)],
    "pair": [(1, 2), (2, 1), (1, 1), (3, 3)],
    "no cycle": [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)],
    "dense": [(a, b) for a in range(5) for b in range(5)] + [(a, b) for a in range(5, 9) for b in range(5, 9)] + [(4, 5), (3, 6)],
}


def test_shapes_of_cycles(spark):
    """All shapes as one graph: their nodes are kept apart, and each shape's components are compared by name."""
    edges = [(100 * k + a, 100 * k + b) for k, shape in enumerate(SHAPES.values()) for a, b in shape]
    rows = [tuple(r) for r in G.cycles(spark.createDataFrame(edges, "src long, tgt long"), Scratch(spark, "t")).collect()]
    for k, (name, shape) in enumerate(SHAPES.items()):
        assert sorted((c - 100 * k, n - 100 * k) for c, n in rows if n // 100 == k) == plain(shape), name


def test_random_graphs_at_once(spark):
    """Many graphs of different density as one graph: their nodes are kept apart."""
    rng = random.Random(7)
    edges = [(100 * g + rng.randrange(n), 100 * g + rng.randrange(n)) for g in range(150) for n in [rng.randrange(2, 25)] for _ in range(rng.randrange(1, 3 * n))]
    got = G.cycles(spark.createDataFrame(edges, "src long, tgt long"), Scratch(spark, "t")).collect()
    assert sorted((r.component, r.node) for r in got) == plain(edges)


def test_long_path_takes_few_rounds(spark):
    n, scratch = 10_000, Scratch(spark, "t")
    edges = [((k * 7919) % n, ((k + 1) * 7919) % n) for k in range(n - 1)] + [((n - 1) * 7919 % n, (n - 4) * 7919 % n)]
    got = {(r.component, r.node) for r in G.cycles(spark.createDataFrame(edges, "src long, tgt long"), scratch).collect()}
    tail = [k * 7919 % n for k in range(n - 4, n)]
    assert got == {(min(tail), x) for x in tail}
    assert scratch.n < 40


def test_pagerank_uncalled(spark, tmp_path):
    """P4 and P5 have no caller, P6 only P5: the query equals its SQL, which loses them, and the operator keeps them."""
    calls = [(1, 2), (2, 3), (3, 2), (4, 2), (5, 6), (6, 1)]
    lines = [(o, part, n, "R", "O") for o, pair in enumerate(calls) for n, part in enumerate(pair)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, "STD", "B#1", 1) for k in range(1, 7)], "p_partkey long, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["pagerank"]).fetchall())
    assert [n for n, _ in want] == ["com.std.b1.P2", "com.std.b1.P3"]
    assert sorted(tuple(r) for r in entry.queries()["pagerank"](spark, str(tmp_path)).collect()) == want
    edges = spark.createDataFrame(calls, "src long, tgt long")
    rank = {r.node: r["rank"] for r in G.pagerank(edges, Scratch(spark, "t")).collect()}
    assert sorted(rank) == [1, 2, 3, 4, 5, 6] and rank[4] == pytest.approx(0.15 / 6) and rank[6] == pytest.approx(0.15 / 6 * 1.85)
