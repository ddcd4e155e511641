import random
import re
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as C
from sparkloom.llm import toxicity
from sparkloom.util import Scratch
from tests.llm.test_jaccard import brute as brute_components
from tests.llm.test_models import brute_pii

SF = "/root/testdata/sf0.001"


def brute_cut(docs):
    seen, out = set(), {}
    for doc, text in sorted(docs.items()):
        b = text.encode()
        gone = [False] * len(b)
        for i in range(len(b) - 99):
            s = b[i : i + 100]
            if s in seen:
                gone[i : i + 100] = [True] * 100
            seen.add(s)
        kept, at = [], 0
        for c in text:
            n = len(c.encode())
            if not any(gone[at : at + n]):
                kept.append(c)
            at += n
        out[doc] = "".join(kept)
    return out


def test_stages(spark):
    from pyspark.sql import functions as F

    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard", "suffix_array", "pii", "packing"]
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), Scratch(spark, "t")
    text = {r.doc_id: r.text for r in docs.collect()}
    meta = {r.doc_id: (r.lang, r.source) for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), Scratch(spark, "t"), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    bad = {r.doc_id for r in toxicity.score_documents(docs, model).collect() if r.score >= 0.3}
    want = {d: t for d, t in text.items() if d not in bad}
    step = scratch.keep(C.toxic(spark, docs, SF))
    assert step.columns == docs.columns and {r.doc_id: r.text for r in step.collect()} == want
    comp = brute_components(list(want.items()), C.NEAR)
    want = {d: t for d, t in want.items() if comp[d][1] == d}
    step = scratch.keep(C.near_duplicates(spark, step, SF))
    assert step.columns == docs.columns and {r.doc_id: r.text for r in step.collect()} == want
    want = brute_cut(want)
    step = scratch.keep(C.repeated_passages(spark, step, SF))
    rows = step.collect()
    assert step.columns == docs.columns and {r.doc_id: r.text for r in rows} == want and all((r.lang, r.source) == meta[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    step = scratch.keep(C.personal_data(spark, step, SF))
    rows = step.collect()
    assert step.columns == docs.columns and len(rows) == len(want)
    for r in rows:
        if not brute_pii(want[r.doc_id]) and not re.search(r'token = "|[0-9][-. ][0-9]{4}', want[r.doc_id]):
            assert r.text == want[r.doc_id]
        assert not re.search(r'token = "[0-9a-f]{40}"', r.text)
        assert not [x for x in brute_pii(r.text) if x[0] in ("email", "card", "phone")] and r.n_chars == len(r.text)
    last = {r.doc_id: r.text for r in rows}
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    parts = {}
    for r in C.sequences(spark, step, SF).collect():
        parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    assert {d: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for d, p in parts.items()} == {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in last.items()}


def test_near_duplicates_null_and_repeated_ids(spark):
    """One row of a group stays, whatever its ids, and the texts of other groups with it."""
    r = random.Random(8)
    text = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200))
    a, b, c, d = text(), text(), text(), text()
    docs = [(None, a), (None, a), (None, a + " end"), (None, b), (4, b), (7, c), (7, c), (7, d), (3, d + " end"), (8, c + " end"), (None, ""), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [tuple(x) for x in C.near_duplicates(spark, df, SF).collect()]
    groups = sorted((x[1] or "")[:50] for x in got)
    assert groups == sorted(["", "", *(t[:50] for t in (a, b, c, d))])
    assert (None, b) in got and (7, c) in got and (3, d + " end") in got


def test_run(spark):
    out = C.run(spark, SF)
    assert out.count() and {"doc_id", "sequence_id", "ids"} <= set(out.columns)


ODD = "doc_id long, text string, lang string, source string, n_chars long, body string, doc long, c0 string, spans string, key int"


def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing column names: each stage has a defined result."""
    r = random.Random(3)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c = text(60), text(60), text(40_000)
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, None), (3, None), (4, ""), (None, ""), (5, c), (6, c[:-6] + "zzzzzz"), (7, "call 555-123-4567 é"), (8, "\u00e9" * 300), (9, " \n\t ")]
    docs = spark.createDataFrame([(i, t, None, "s", None, "x", 5, None, "y", 1) for i, t in rows], ODD).repartition(3)
    empty = docs.limit(0)
    for name, stage in C.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = [tuple(x) for x in out.collect()]
        assert stage(spark, empty, SF).collect() == [], name
        texts = sorted((x[0] is not None, x[0] or 0, x[1] or "") for x in got)
        assert all(x[3] == "s" and x[5:] == ("x", 5, None, "y", 1) for x in got), name
        if name == "toxicity":
            assert len(got) <= len(rows)
        elif name == "ngram_jaccard":  # one row of each group, and every row without a word
            assert len(got) == 10 and [x[2] for x in texts].count(a) == 1 and [x[2] for x in texts].count(b) == 1
        elif name == "suffix_array":  # repeated rows with an id lose alike, rows without one lose what an earlier row holds
            assert len(got) == len(rows) and sum(len(x[2]) > 50_000 for x in texts) == 1
            assert [x[2] for x in texts if not x[0]].count(b) == 1
        else:
            assert len(got) == len(rows) and (True, 7, "call <phone> é") in texts
    packed = C.sequences(spark, docs, SF).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sum(x.length for x in packed) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows) and C.sequences(spark, empty, SF).collect() == []
