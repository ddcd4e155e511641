"""Duplicate groups against the sequential rule, written out."""

import random

import pytest

from sparkloom.operators import clones as C
from sparkloom.util import Scratch


def greedy(files, least):
    """All matches, longest first; one goes if both its ranges are covered by those that stay."""
    names, matches = sorted(files), []
    places = [(f, i) for f in names for i in range(len(files[f]) - least + 1)]
    for n, (f, i) in enumerate(places):
        for g, j in places[n + 1 :]:
            x, y, size = files[f], files[g], 0
            while i + size < len(x) and j + size < len(y) and x[i + size] == y[j + size]:
                size += 1
            if size >= least and (f != g or j - i >= size):
                matches.append((-size, f, i, g, j))
    stay, covered = set(), []
    for size, f, i, g, j in sorted(matches):
        inside = lambda h, k: any(h == c and s <= k and k - size <= e for c, s, e in covered)  # noqa: B023, E731
        if not (inside(f, i) and inside(g, j)):
            stay.add((f, i, g, j, -size))
            covered += [(f, i, i - size), (g, j, j - size)]
    return stay


def tokens(spark, files):
    rows = [(f, k, t, k // 7 + 1) for f, text in files.items() for k, t in enumerate(text)]
    return spark.createDataFrame(rows, "file string, offset int, text string, line int").repartition(3)


def found(spark, files, least):
    return C.duplicate_groups(tokens(spark, files), Scratch(spark, "t"), least).collect()


@pytest.mark.parametrize("seed", range(4))
def test_equals_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    passages = [[r.choice("abc") for _ in range(n)] for n in (12, 20, 33)]
    files = {}
    for k in range(9):
        text = []
        for _ in range(r.randint(0, 5)):
            text += [r.choice("abcdefgh") for _ in range(r.randint(0, 6))] + r.choice(passages)[r.randint(0, 3) : r.randint(9, 40)]
        files[f"f{k}"] = text
    files["g"] = list("ab" * 25)  # matches that would overlap themselves
    files["h"] = files["g"][1:40] + ["z"] + files["f2"]
    got = found(spark, files, 6)
    assert {tuple(x)[:5] for x in ((r.file_a, r.start_a, r.file_b, r.start_b, r.length) for r in got)} == greedy(files, 6)
    for r in got:
        assert (r.first_line_a, r.last_line_a) == (r.start_a // 7 + 1, (r.start_a + r.length - 1) // 7 + 1)
        assert (r.first_line_b, r.last_line_b) == (r.start_b // 7 + 1, (r.start_b + r.length - 1) // 7 + 1)


def test_copies_cost_a_row_each(spark):
    r = random.Random(5)
    body = [str(r.random()) for _ in range(80)]
    files = {f"f{k:03}": [f"a{k}", *body, f"b{k}"] for k in range(60)}
    got = found(spark, files, 50)
    assert sorted((x.file_a, x.start_a, x.file_b, x.start_b, x.length) for x in got) == [("f000", 1, f"f{k:03}", 1, 80) for k in range(1, 60)]


def test_none(spark):
    assert found(spark, {"a": ["x"] * 5, "b": []}, 50) == []
    assert found(spark, {"a": [str(i) for i in range(200)]}, 50) == []


def test_long_copies_take_few_rounds(spark):
    body = [str(k) for k in range(5000)]
    files = {"a": ["x", *body[:4321], "y"], "b": [*body, "z"], "c": body[17:3000]}
    scratch = Scratch(spark, "t")
    got = C.duplicate_groups(tokens(spark, files), scratch, 50).collect()
    assert {(r.file_a, r.start_a, r.file_b, r.start_b, r.length) for r in got} == {("a", 1, "b", 0, 4321), ("a", 18, "c", 0, 2983)}
    assert scratch.n < 25


def test_writes_few_places(spark):
    """Only anchors, and windows about the start of a match, become rows: before, each place of each text did."""

    class Counted(Scratch):
        rows = 0

        def keep(self, df):
            out = super().keep(df)
            self.rows += out.count() if "off" in out.columns else 0
            return out

    r = random.Random(7)
    body = [str(r.random()) for _ in range(120)]
    files = {f"f{k}": [str(r.random()) for _ in range(400 + k)] + body * (k % 3 == 0) for k in range(9)}
    scratch = Counted(spark, "t")
    got = C.duplicate_groups(tokens(spark, files), scratch, 50).collect()
    assert {(x.file_a, x.start_a, x.file_b, x.start_b, x.length) for x in got} == {("f0", 400, "f3", 403, 120), ("f0", 400, "f6", 406, 120)}
    assert scratch.rows < sum(map(len, files.values())) / 4


def test_short_windows(spark):
    """Windows of three tokens, whose anchors are single ones."""
    r = random.Random(11)
    files = {f"f{k}": [r.choice("abcdefgh") for _ in range(r.randint(2, 25))] for k in range(6)}
    assert {(x.file_a, x.start_a, x.file_b, x.start_b, x.length) for x in found(spark, files, 3)} == greedy(files, 3)


def test_rounds_write_one_table(spark):
    """A round of the search writes the places that go on, and nothing else: four tables before."""
    body = [str(k) for k in range(1000)]
    scratch = Scratch(spark, "t")
    got = C.duplicate_groups(tokens(spark, {"a": ["x", *body[:700], "y"], "b": [*body, "z"]}), scratch, 50).collect()
    assert [(r.file_a, r.start_a, r.file_b, r.start_b, r.length) for r in got] == [("a", 1, "b", 0, 700)]
    assert scratch.n <= 10
