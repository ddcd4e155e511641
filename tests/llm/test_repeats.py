import hashlib
import random
import re

import pytest

from sparkloom.llm import queries as Q
from sparkloom.llm.automaton import Automaton, dedup_windows
from sparkloom.llm.suffix import BlindTrie, dedup_substrings, deep_shallow
from sparkloom.util import Scratch

import numpy as np


def brute(docs, unit):
    """The contract, position by position."""
    seen, out = set(), {}
    w = 100 if unit == "bytes" else 20
    for doc, text in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        seq = (text or "").encode() if unit == "bytes" else re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = [False] * len(seq)
        for i in range(len(seq) - w + 1):
            s = seq[i : i + w] if unit == "bytes" else tuple(seq[i : i + w])
            if s in seen:
                gone[i : i + w] = [True] * w
            seen.add(s)
        kept = bytes(b for b, g in zip(seq, gone) if not g) if unit == "bytes" else " ".join(x for x, g in zip(seq, gone) if not g).encode()
        out[doc] = (len(seq), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), kept)
    return out


def fixture(seed=3, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["th", "er", "on", "é", "re"]) for _ in range(r.randint(1, 4)))
    para = [" ".join(word() for _ in range(r.randint(15, 70))) for _ in range(8)]
    docs = [(0, None), (1, ""), (2, "a" * 700), (3, "a" * 300 + "b"), (4, "x y " * 90), (5, "é" * 120), (6, "é" * 130), (7, "x y " * 30)]
    for i in range(8, n):
        parts = [" ".join(word() for _ in range(r.randint(1, 30))) if r.random() < 0.6 else r.choice(para) for _ in range(r.randint(1, 6))]
        text = r.choice([" ", "\n", "\x0b"]).join(parts)
        if r.random() < 0.3:
            k = r.randrange(len(text))
            text = text[:k] + "#" + text[k:]
        docs.append((i, text))
    docs += [(n, docs[20][1]), (n + 1, docs[20][1]), (None, docs[21][1]), (n + 2, " ".join(word() for _ in range(9000)) + para[0])]
    return docs


@pytest.mark.parametrize("hot", [2, 512])
@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_matches_brute_force(spark, unit, hot):
    from dataclasses import replace

    from sparkloom.llm.automaton import WORDS
    from sparkloom.llm.suffix import BYTES

    docs = fixture()
    rows = [(d, t, "zz", i) for i, (d, t) in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string, pos int").repartition(5)
    f, kind = (dedup_substrings, BYTES) if unit == "bytes" else (dedup_windows, WORDS)
    got = {r.doc_id: (r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in f(df, Scratch(spark, "t"), kind=replace(kind, hot=hot)).collect()}
    assert got == brute(docs, unit)


def thue_morse(n=10):
    """A word and its complement: equal under every polynomial hash modulo 2**64."""
    x = "a"
    for _ in range(n):
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_long_words(spark):
    """Long words that differ anywhere are different words."""
    r = random.Random(6)
    base = ["".join(r.choice("abcd") for _ in range(r.choice([3, 30, 65, 300]))) for _ in range(25)]
    x, y = thue_morse()
    docs = [(1, " ".join([*base[:12], x, *base[12:24]])), (2, " ".join([*base[:12], y, *base[12:24]])), (3, " ".join(base[:3] + [x] + base[3:22])), (4, " ".join([*base[:12], x, *base[12:24]]))]
    docs += [(5 + i, " ".join(base[:i] + [base[i][:-1] + "z"] + base[i + 1 :])) for i in range(25)]
    docs += [(40, "q" * 5_000_000 + " " + " ".join(base)), (41, "q" * 4_999_999 + "p " + " ".join(base))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in dedup_windows(df, Scratch(spark, "t")).collect()}
    assert got == brute(docs, "words")
    assert got[2][1] == 0 and got[4][1] == 25


def test_empty_and_twice(spark):
    schema = "doc_id long, text string"
    assert dedup_substrings(spark.createDataFrame([], schema), Scratch(spark, "t")).count() == 0
    twice = spark.createDataFrame([(1, "ab" * 200 + "c" * 150), (1, "ab" * 200 + "c" * 150), (2, None)], schema)
    rows = dedup_substrings(twice, Scratch(spark, "t")).collect()
    assert len(rows) == 3 and len({(r.n_removed, bytes(r.kept)) for r in rows if r.doc_id == 1}) == 1


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_null_and_repeated_ids(spark, unit):
    """Rows without an id are documents of their own, as are other texts of one id."""
    from pyspark.sql import functions as F

    texts = [t for _, t in fixture(5, 40)]
    short = "only a few words"
    docs = [(None if i % 3 == 0 else i % 7, t) for i, t in enumerate(texts)] + [(None, t) for t in (texts[9], texts[9], texts[12], texts[13], short, short, None)]
    docs += [(3, texts[10]), (3, texts[10]), (-(2**63), texts[11])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    hash_ = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    once = [x for i, x in enumerate(docs) if x[0] is None or x not in docs[:i]]
    once.sort(key=lambda x: (x[0] is not None, x[0] or 0, hash_[x[1]]))
    made = brute([(i, t) for i, (_, t) in enumerate(once)], unit)
    want = [(d, *made[i]) for i, (d, _) in enumerate(once)]
    want += [w for w, (d, t) in zip(want, once) if d is not None for _ in range(docs.count((d, t)) - 1)]
    f = dedup_substrings if unit == "bytes" else dedup_windows
    got = [(r.doc_id, r.n_symbols, r.n_removed, r.n_spans, bytes(r.kept)) for r in f(df, Scratch(spark, "t")).collect()]
    order = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_queries(spark, unit):
    d = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    want = brute(docs, unit)
    for r in (Q.op3_suffix_dedup if unit == "bytes" else Q.op5_substring_dedup)(spark, d).collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r[1], r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept).hexdigest())
        assert unit == "words" or r.n_spans == spans


def test_sorting():
    r = random.Random(1)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 9))) * r.randint(1, 12) for _ in range(500)]
    group = np.array([r.randrange(4) for _ in strings])
    order, lcp = deep_shallow(strings, group)
    assert [(group[i], strings[i]) for i in order] == sorted((group[i], s) for i, s in enumerate(strings))
    for a, b, n in zip(order, order[1:], lcp[1:]):
        x, y = strings[a], strings[b]
        k = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
        assert n == (k if group[a] == group[b] else -1)
    trie = BlindTrie(strings)
    for i in range(len(strings)):
        trie.add(i)
    assert [strings[i] for i in trie.order()] == sorted(strings)


def test_automaton():
    r = random.Random(2)
    texts = [[r.randrange(3) for _ in range(30)] for _ in range(6)]
    a = Automaton()
    for t in texts:
        a.add(t)
    subs = {tuple(t[i:j]) for t in texts for i in range(30) for j in range(i + 1, 31)}
    q = [r.randrange(4) for _ in range(60)]
    assert a.statistics(q) == [max([0, *(k for k in range(1, i + 2) if tuple(q[i + 1 - k : i + 1]) in subs)]) for i in range(60)]
