"""Periodic runs: the automaton against a plain search, and odd rows."""

import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from sparkloom.llm import queries as Q
from sparkloom.llm.runs import Automaton, Ordered, find_runs, runs_of


def plain(w, least, exponent):
    """Every period by itself: maximal stretches of words q apart that are equal."""
    out, n = {}, len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, length, q) for (s, length), q in out.items())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50), st.integers(1, 12), st.integers(3, 4))
def test_runs_equal_a_plain_search(w, least, exponent):
    assert runs_of(w, least, exponent) == plain(w, least, exponent)


@pytest.mark.parametrize("period", [1, 7, 50, 900])
def test_planted_runs(period):
    rng = random.Random(period)
    base = [rng.randrange(50) for _ in range(period)]
    w = [rng.randrange(50) for _ in range(333)] + (base * 40)[: period * 4 + 30] + [99] + [rng.randrange(50) for _ in range(100)]
    assert runs_of(w) == plain(w, 24, 3) != []


def test_automaton_holds_every_substring():
    w = [0, 1, 1, 0, 1, 0, 0, 1]
    a = Automaton(w)
    # distinct substrings are counted by the lengths that each state adds
    assert sum(a.length[v] - a.length[a.link[v]] for v in range(1, len(a.length))) == len({tuple(w[i:j]) for i in range(8) for j in range(i + 1, 9)})


def test_ordered_set_gives_neighbours():
    rng, s, held = random.Random(3), Ordered(5000), [5000]
    for x in rng.sample(range(5000), 4000):
        before, after = s.insert(x)
        assert before == max((y for y in held if y < x), default=-1) and after == min((y for y in held if y > x), default=-1)
        held.append(x)
    assert list(s) == sorted(held)


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def test_texts(spark):
    rng = random.Random(1)
    noise = lambda n: [rng.choice(["ä", "b", "𝄞x", "d"]) for _ in range(n)]
    texts = [None, "", " \n\t", "one", "x " * 23, "x " * 24, " ".join(["a", "b"] * 12), " ".join((noise(5) * 12 + noise(40)) * 3), "\x0b".join(noise(3000)), " ".join(["w"] * 60_000), " ".join(["p q r"] * 10 + ["stop"] + ["p q r"] * 10)]
    texts += [" ".join([*noise(100), *(noise(60) * 5), *noise(30)]), texts[-1]]
    rows = [(i if i != 3 else None, t, "n", 1) for i, t in enumerate(texts)] + [(4, "x " * 23, "n", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs int").repartition(3)
    got = find_runs(docs).collect()
    assert len(got) == len(rows)
    want = {(i, t) for i, t, *_ in rows}
    for r in got:
        words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in want if i == r.doc_id]
        runs = [(x.start, x.length, x.period) for x in r.runs]
        # the text of 60,000 equal words has one run; the plain search would be slow there
        (one,) = {tuple(w) for w in words if len(w) == r.n_words}
        assert runs == ([(0, 60_000, 1)] if r.n_words == 60_000 else plain(one, 24, 3))
        assert r.collapsed.decode() == collapse(one, runs)


def test_empty_table_and_parameters(spark):
    assert find_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    with pytest.raises(ValueError):
        find_runs(spark.createDataFrame([], "doc_id long, text string"), min_exponent=2)


def test_query_repeats_words_as_asked(spark):
    import zlib

    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 31}" for k in range(i % 90))) for i in range(300)] + [(None, "a b"), (1000, None)]
    for r in Q.periodized(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.doc_id is None or r.text is None:
            continue
        h, w = zlib.crc32(str(r.doc_id).encode()), dict(docs)[r.doc_id].split()
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert r.text.split() == w
