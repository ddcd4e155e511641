import os
import random
import re

import numpy as np
import pytest

from sparkloom.llm import jaccard as J, queries as Q
from sparkloom.util import Scratch


def brute(docs, join=J.Join()):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[d] = frozenset(tuple(w[i : i + join.words]) for i in range(len(w) - join.words + 1)) if len(w) >= join.words else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and join.den * min(len(x), len(y)) >= join.num * max(len(x), len(y)) and join.linked(len(x & y), len(x | y)):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {d: (len(sets[d]), find(d)) for d in ids}


def fixture(seed, n=220):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdEFé") for _ in range(r.randint(1, 4)))
    docs = [None, "", "a", "A", "a b", "a b ", "x y z", "X  y\tz", "q " * 50]
    while len(docs) < n:
        base = [word() for _ in range(r.choice([4, 12, 40, 150, 400]))]
        docs.append(" ".join(base))
        for _ in range(r.choice([0, 1, 3, 12])):
            c = docs[-1].split(" ") if r.random() < 0.5 else list(base)
            for _ in range(r.randint(0, max(1, len(c) // 40))):
                c[r.randrange(len(c))] = word()
            docs.append(" ".join(c))
    return list(enumerate(docs))


@pytest.mark.parametrize(("join", "seed"), [(J.Join(), 1), (J.Join(block=3), 2), (J.Join(words=5, num=80), 3), (J.Join(words=5, num=80, block=2), 4)])
def test_brute_force(spark, join, seed):
    docs = fixture(seed)
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id long, text string, key int, set_id int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, Scratch(spark, "t"), join).collect()}
    assert got == brute(docs, join)


def test_keys_meet():
    """Any linked pair shares a key, also where differences are spread as badly as can be."""
    r = np.random.default_rng(4)
    for num in (80, 90):
        join = J.Join(num=num)
        bounds = join.bounds()
        starts = np.array([b[0] for b in bounds])
        for _ in range(1500):
            n = int(r.choice([5, 8, 12, 20, 60, 300]))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            cut = r.integers(0, max(1, n // 5) + 1)
            b = np.unique(np.concatenate((a[cut:], r.integers(0, 2**63, r.integers(0, n // 6 + 1)).astype(np.uint64) * np.uint64(2) + np.uint64(1))))
            both = len(np.intersect1d(a, b))
            if len(b) and not np.array_equal(a, b) and join.linked(both, len(a) + len(b) - both):
                common = np.intersect1d(J.keys_of(a, bounds, starts, join), J.keys_of(b, bounds, starts, join))
                # more than the spare keys of some class are shared, so the least common of them is kept by both
                assert any(n > bounds[c][4] for c, n in enumerate(np.bincount((common & np.uint64(127)).astype(int))))


def test_odd(spark):
    schema = "doc_id long, text string"
    assert J.jaccard_components(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    rows = J.jaccard_components(spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (5, None), (6, "")], schema), Scratch(spark, "t")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in rows if r.doc_id in (5, 6)) == [(False, 5, 0, 5), (False, 6, 0, 6)]
    assert [r.component_id for r in rows if r.doc_id in (3, None)] == [None] * 3


def test_long_words(spark):
    from tests.llm.test_repeats import thue_morse

    x, y = thue_morse()
    docs = [(1, f"one two {x}"), (2, f"one two {y}"), (3, f"One two {x}"), (4, x), (5, y), (6, "z" * 3_000_000), (7, "z" * 2_999_999 + "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, Scratch(spark, "t")).collect()}
    assert got == brute(docs) and got[2][1] == 2 and got[3][1] == 1


def test_query(spark):
    d = "/root/testdata/sf0.001"
    want = brute([(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in Q.op9_jaccard_join(spark, d).collect()} == want


def test_null_and_repeated_ids(spark):
    """Rows without an id, and other texts of one id, bring only sets of their own; each wanted set is read once."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = text(200), text(200), text(200)
    near = lambda t: t + " end"
    docs = [(None, a), (None, near(a)), (None, b), (None, b), (None, ""), (4, near(b)), (7, c), (7, near(a)), (9, near(c)), (7, c)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    scratch = Scratch(spark, "t")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in J.jaccard_components(df, scratch).collect()), key=str)
    n = len(a.split()) - 2
    assert got == sorted([(None, n, None), (None, n + 1, None), (None, n, None), (None, n, None), (None, 0, None), (4, n + 1, None), (7, n, 7), (7, n + 1, None), (9, n + 1, 7), (7, n, 7)], key=str)
    read = [t for t in (spark.read.parquet(p) for p in scratch.paths.values() if os.path.exists(p.removeprefix("file://"))) if t.columns == ["set_id", "tokens"]]
    assert len(read) == 1
    rows = read[0].collect()
    assert len(rows) == len({x.set_id for x in rows}) and all(J.set_id(np.frombuffer(x.tokens, np.uint64)) == x.set_id for x in rows)


def test_unlike_sets_of_a_group_are_not_looked_at_one_by_one():
    """Sets that share a third of their tokens: bitmaps tell them apart, leaf by leaf, but for one linked pair."""
    r = np.random.default_rng(3)
    shared = r.integers(0, 2**63, 100).astype(np.uint64)
    sets = [np.unique(np.concatenate((shared, r.integers(0, 2**63, 200).astype(np.uint64)))) for _ in range(600)]
    sets.append(np.unique(np.append(sets[17], np.uint64(5))))

    class Counting(J.Forest):
        found = 0

        def find(self, x):
            Counting.found += 1
            return super().find(x)

    assert J.tree_join(sets, J.Join(), Counting(len(sets))) in ([(17, 600)], [(600, 17)])
    assert Counting.found < 5 * len(sets)
