"""Nearest neighbours and hard negatives against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import bitslice, cells, onebit
from sparkloom.util import Scratch

ROWS = "vec_id long, embedding array<float>, label int"


def table(spark, x, labels=None, ids=None):
    ids = range(len(x)) if ids is None else ids
    labels = [0] * len(x) if labels is None else labels
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], c) for i, v, c in zip(ids, x, labels, strict=True)], ROWS).repartition(5)


def near(rows, every, k):
    """Per query the k best by plain products."""
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in list(v) and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for i, v in good:
        if i % every == 0:
            out[i] = sorted((-float(v @ w), j) for j, w in good if j != i and len(w) == len(v))[:k]
    return out


def clusters(n, dim, seed=0, groups=12):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((groups, dim)) * 2
    return (centre[rng.integers(0, groups, n)] + rng.standard_normal((n, dim))).astype(np.float32)


@pytest.mark.parametrize("dim", [3, 64])
def test_recall_over_many_cells(spark, dim):
    x = clusters(1500, dim)
    got = onebit.nearest(table(spark, x), F.col("id") % 20 == 0, Scratch(spark, "t"), cell=100).collect()
    want = near(list(enumerate(x)), 20, 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = sum(len({v for _, v, _ in by[q]} & {j for _, j in w}) for q, w in want.items())
    assert set(by) == set(want) and all([p for p, _, _ in sorted(b)] == list(range(1, 21)) for b in by.values())
    assert hits / sum(map(len, want.values())) >= 0.99
    assert all(s == pytest.approx(float(x[q].astype(float) @ x[v].astype(float)), abs=1e-9) for q, b in by.items() for _, v, s in b)


def test_bound_and_codes_do_the_choosing(spark):
    """Estimates stay within the bound nearly always, and the bound leaves most points out."""
    x = clusters(2000, 64, 3).astype(float)
    centre = x.mean(0)
    codes, fit, along = onebit.encode(x, centre)
    length = np.sqrt(((x - centre) ** 2).sum(1))
    guess, off = onebit.estimate(codes, length, fit, along, centre, x[:50], 4.0)
    true = x[:50] @ x.T
    assert (np.abs(guess - true) <= off).mean() > 0.999
    assert (guess + off >= cells.kth(guess - off, 21)[:, None]).mean() < 0.5
    assert np.corrcoef(guess.ravel(), true.ravel())[0, 1] > 0.9


def test_odd_vectors(spark):
    x = [*clusters(90, 4, 5), None, [], [0, 0, 0, 0], [1, None, 0, 0], [float("nan"), 1, 1, 1], [float("inf"), 1, 1, 1], [1, 2], [2, 1]]
    x += [x[20]] * 60 + [x[0]] * 30  # groups of copies, of a query too
    ids = [*range(len(x) - 1), None]
    got = onebit.nearest(table(spark, x, ids=ids).withColumn("x", F.lit("clash")).withColumn("point", F.lit(1)), F.col("id") % 10 == 0, Scratch(spark, "t"), k=7, cell=16).collect()
    want = near(list(zip(ids, x, strict=True)), 10, 7)
    by = {}
    for r in sorted(got, key=lambda r: r.rank):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(by) == {q for q, w in want.items() if w}
    for q, w in want.items():
        if w:
            assert [v for v, _ in by[q]] == [j for _, j in w] and [-s for _, s in by[q]] == pytest.approx([s for s, _ in w])


def test_repeated_rows_and_empty(spark):
    x = clusters(40, 4, 6)
    twice = [*x, *x]
    ids = [*range(40), *range(40)]
    a = onebit.nearest(table(spark, twice, ids=ids), F.col("id") % 5 == 0, Scratch(spark, "t"), k=3).collect()
    b = onebit.nearest(table(spark, x), F.col("id") % 5 == 0, Scratch(spark, "t"), k=3).collect()
    assert sorted(a) == sorted(b) and len(b) == 24
    assert onebit.nearest(spark.createDataFrame([], ROWS), F.col("id") % 5 == 0, Scratch(spark, "t")).collect() == []


def mined(rows, every, n_pos=5, n_neg=3, low=50, high=95):
    out = []
    good = [(i, c, np.array(v, np.int64)) for i, c, v in rows if i is not None and c is not None and v is not None and len(v) and None not in list(v)]
    for i, c, v in good:
        if i % every:
            continue
        scored = sorted((-int(v @ w), j, d) for j, d, w in good if j != i and len(w) == len(v))
        for s, j, _ in [r for r in scored if r[2] == c][:n_pos]:
            fits = [(t, m) for t, m, d in scored if d != c and low * -s <= 100 * -t <= high * -s]
            out += [(i, j, rank, m, -s, -t) for rank, (t, m) in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def ints(spark, rows):
    return spark.createDataFrame([(i, c, None if v is None else [None if e is None else int(e) for e in v]) for i, c, v in rows], "id long, label int, v array<long>").repartition(4)


@pytest.mark.parametrize("scale", [20, 256, 40_000])
def test_negatives_equal_brute_force(spark, scale):
    x = np.floor(clusters(700, 16, 9, 5) / 4 * scale)
    rows = [(i, i * 7 % 4, v) for i, v in enumerate(x)]
    got = bitslice.hard_negatives(ints(spark, rows), F.col("id") % 25 == 0, Scratch(spark, "t"), cell=90).collect()
    assert sorted(map(tuple, got)) == mined(rows, 25) != []


def test_negatives_of_odd_rows(spark):
    x = np.floor(clusters(150, 4, 2, 3) * 3)
    rows = [(i, i % 3, v) for i, v in enumerate(x)]
    rows += [(200 + i, 1, x[7]) for i in range(40)] + [(300 + i, 2, x[7]) for i in range(40)]  # copies in two labels
    rows += [(400, None, x[1]), (410, 1, None), (420, 1, [1, None, 2, 3]), (430, 1, []), (440, 1, [0, 0, 0, 0]), (450, 1, [3, 4]), (455, 2, [3, 3]), (457, 1, [5, 5]), (None, 1, x[3])]
    got = bitslice.hard_negatives(ints(spark, [*rows, *rows]).withColumn("x", F.lit(1)).withColumn("query", F.lit(1)), F.col("id") % 10 == 0, Scratch(spark, "t"), cell=32).collect()
    assert sorted(map(tuple, got)) == mined(rows, 10)
    assert bitslice.hard_negatives(ints(spark, []), F.col("id") % 10 == 0, Scratch(spark, "t")).collect() == []


def test_intervals_drop_nothing_that_qualifies():
    rng = np.random.default_rng(4)
    a, p = rng.integers(-99, 99, (30, 8)).astype(float), rng.integers(-99, 99, (400, 8)).astype(float)
    true = a @ p.T
    floors, highs = np.quantile(true, [0.5, 0.9], axis=1).T, np.quantile(true, [0.7, 1.0], axis=1).T
    got = set(zip(*(c.tolist() for c in bitslice.sliced(a, p, np.ones_like(true, bool), floors, highs, np.arange(400), 3)), strict=True))
    want = {(i, w, j, true[i, j]) for i in range(30) for w in range(2) for j in sorted((j for j in range(400) if floors[i, w] <= true[i, j] <= highs[i, w]), key=lambda j: (-true[i, j], j))[:3]}
    assert got == want
