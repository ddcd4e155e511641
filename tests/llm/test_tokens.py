import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkloom.llm import bpe, packing, queries as Q
from sparkloom.llm.binary_ids import IdFile, read_files, write_files
from sparkloom.llm.chunks import ChunkEncoder, ChunkTable, chunk_starts
from sparkloom.llm.tokens import encoder
from sparkloom.util import Scratch

import base64

ODD = [None, "", " ", "  a", "a  b \n c\t d ", "don't we'll 123 4567!?", "\n\n\n x", "é" * 300, "ab" * 400, "x" * 1000, "Ünï   cödé   z", "a <|endoftext|> b", "a  <|endoftext|>", "\x1c \x85 q", "日本語 テキスト 123", "é ́x", "İstanbul ΣΑΣ"]
WORDS = "doc_id long, text string, lang string, ids int, start int"


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(5)
    out = ODD + ["".join(r.choice(" \n\tabcé'st19!.") for _ in range(r.randint(1, 80))) for _ in range(400)]
    return out + [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_chunks():
    """Chunks begin at rows and at spaces before a character that is no white space, never inside a row's last space."""
    r = random.Random(3)
    rows = ["", " ", "a", "  b", "a b ", " c", "\u00a0 \u00a0x", "p \u2003q", "s \u2014t", "u \u3000v", "\x85 \x1c", "é é", ""] + ["".join(r.choice(" a\u2003\u00e9\u201c\n\u00a0\u3042,-") for _ in range(r.randint(0, 9))) for _ in range(500)]
    raw = [x.encode() for x in rows]
    offsets = np.append(0, np.cumsum(list(map(len, raw))))
    data = np.frombuffer(b"".join(raw), np.uint8)
    want, at = set(), 0
    for x in rows:
        if x:
            want.add(at)
        for i, c in enumerate(x[:-1]):
            if c == " " and not x[i + 1].isspace():
                want.add(at + len(x[:i].encode()))
            if c == "\n" and i and not x[i - 1].isspace() and not x[i + 1].isspace():
                want |= {at + len(x[:i].encode()), at + len(x[: i + 1].encode())}
            if c.isalpha() and x[i + 1] in ",-":
                want.add(at + len(x[: i + 1].encode()))
        at += len(x.encode())
    got = set(chunk_starts(data, offsets).tolist())
    assert got <= want
    sure = {i for i in want if i in offsets or (data[i] == 32 and data[i + 1] < 128)}
    assert sure <= got


def test_chunk_table():
    """Ids by exact bytes, also where the table fills up and starts anew, and for bytes of zero."""
    calls = []

    def learn(chunks):
        calls.append(len(chunks))
        return [np.frombuffer(c.encode(), np.uint8).astype("<u4").tobytes() for c in chunks]

    r = random.Random(4)
    e = ChunkEncoder(learn, [b"<x>"], entries=300)
    for _ in range(20):
        texts = [" ".join("".join(r.choice("ab\0é") for _ in range(r.choice([0, 1, 2, 7, 8, 9, 22, 23, 24, 60]))) for _ in range(r.randint(0, 40))) for _ in range(50)] + ["a\0", "a", "a <x> b", None]
        assert [x.tolist() for x in e.texts(texts)] == [list((t or "").encode()) for t in texts]
        assert e.table.n <= 300 + max(calls)
    assert ChunkTable().find([np.zeros(2, np.uint64)] * 3).tolist() == [-1, -1]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder(texts, file):
    t = Tokenizer.from_file(P.path(file))
    for x, got in zip(texts, encoder(P.path(file)).texts(texts), strict=True):
        assert got.tolist() == t.encode(x or "", add_special_tokens=False).ids, x


def test_bpe(spark, texts, tik):
    c = bpe.Codec(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for x, ids in zip(texts, c.texts(texts), strict=True):
        assert ids.tolist() == tik.encode_ordinary(x or ""), x
        assert c.decode(ids, np.array([0, len(ids)]))[0].tobytes() == (x or "").encode()
    r = random.Random(1)
    long = ["".join(r.choice("abét") for _ in range(n)) for n in (150, 191, 192, 193, 400, 3000)]
    for x, ids in zip(long, c.texts(long), strict=True):
        assert ids.tolist() == tik.encode_ordinary(x)


def test_op6(spark, tik):
    d = "/root/testdata/sf0.001"
    want = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = Q.op6_byte_bpe(spark, d).collect()
    assert len(rows) == len(want)
    for r in rows:
        ids = tik.encode_ordinary(want[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(want[r.doc_id].encode()).hexdigest())


def test_op10(spark):
    d = "/root/testdata/sf0.001"
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    got = {r.doc_id: r for r in Q.op10_binary_ids(spark, d).collect()}
    for x in sorted(spark.read.parquet(f"{d}/documents.parquet").collect(), key=lambda x: x.doc_id):
        ids = [*t.encode(x.text, add_special_tokens=False).ids, 1]
        r = got.pop(x.doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert not got


@pytest.mark.parametrize("rows", [[], [(i % 30 if i % 31 else None, x, "q", 1, 2) for i, x in enumerate(ODD * 3)]])
def test_odd_rows(spark, rows):
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    files, dictionary = write_files(df, P.path("word_bpe_49k.json"), Scratch(spark, "t"), file_bytes=300)
    out = read_files(files, dictionary).collect()
    assert sorted(r.doc_id is None for r in out) == sorted(x[0] is None for x in rows)
    assert sum(r.n_tokens for r in out) == max([0, *(r.start + r.n_tokens for r in out)])
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = sorted(((x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()) for x in rows))
    want = [([*t.encode(x[3].decode(), add_special_tokens=False).ids, 1]) for x in want]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in sorted(out, key=lambda r: r.start)] == want
    assert files.count() > 3 or not rows
    for r in files.collect():
        with IdFile(r.uri, dictionary) as f:
            assert len(f) == r.n_docs and f.counts.sum() == r.n_ids
            assert [f.document(i).tolist() for i in range(len(f))] == [x.tolist() for x in f.documents(0, len(f))]
        with pytest.raises(ValueError, match="dictionary"):
            IdFile(r.uri, b"another")


@pytest.mark.parametrize("rows", [[], [(i % 30 if i % 31 else None, x, "q", 1, 2) for i, x in enumerate(ODD * 3)]])
def test_odd_rows_packed(spark, tik, rows):
    """Null and repeated ids and texts, empty and long texts, columns of clashing names: every token once."""
    df = spark.createDataFrame(rows, WORDS).repartition(3)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((-1 if i is None else i, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, *_ in rows)
    got = packing.pack_documents(df, P.path("byte_bpe_50k.json"), Scratch(spark, "t")).collect()
    # rows of one id and text length are told apart by their ids only, so whole documents are compared where uncut
    assert sorted((-1 if r.doc_id is None else r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in got if r.length == r.doc_tokens) == [w for w in want if len(w[1]) in {r.length for r in got if r.length == r.doc_tokens}]
    assert sum(r.length for r in got) == sum(len(w[1]) for w in want) and all(len(r.ids) == 4 * r.length for r in got)
    coded = sorted(((-1 if r.doc_id is None else r.doc_id, list(r.ids), bytes(r.decoded)) for r in bpe.encode_documents(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()))
    assert coded == sorted((-1 if i is None else i, tik.encode_ordinary(x or ""), (x or "").encode()) for i, x, *_ in rows)


def _padding(rows):
    seqs = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs[r.sequence_id]
        seqs[r.sequence_id] += r.length
    assert max(seqs.values()) <= 2048
    return 1 - sum(seqs.values()) / (2048 * len(seqs))


@pytest.mark.parametrize("parts", [1, 200])
def test_padding(spark, parts):
    """Padding stays small whatever the number of partitions, and no token is lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {r.doc_id: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect()}
    rows = packing.pack_documents(docs.repartition(parts), P.path("byte_bpe_50k.json"), Scratch(spark, "t")).collect()
    assert _padding(rows) < 0.01
    seen = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == seen[r.doc_id]
        seen[r.doc_id] += r.length
    assert seen == want


def test_loss_limit(spark):
    """With prompts that bear no loss, the loss limit binds where the token limit does not."""
    docs = spark.createDataFrame([(i, "the word and " * 20, 30) for i in range(300)], "doc_id long, text string, answer long").repartition(7)
    limits = packing.Limits(loss=120)
    rows = packing.pack_documents(docs, P.path("byte_bpe_50k.json"), Scratch(spark, "t"), limits=limits, loss_col="answer").collect()
    bears, tokens = defaultdict(int), defaultdict(int)
    for r in rows:
        own = max(0, r.start + r.length - max(r.start, r.doc_tokens - 30))
        assert r.loss == own
        bears[r.sequence_id] += own
        tokens[r.sequence_id] += r.length
    assert sum(bears.values()) == 300 * 30 and max(bears.values()) <= 120 and max(tokens.values()) < 2048
    assert len(bears) <= 300 * 30 / 120 * 1.1


def test_pack_limits():
    r = np.random.default_rng(0)
    n = np.concatenate((r.integers(1, 300, 500), r.integers(1, 9000, 60), np.ones(700, int)))
    loss = r.integers(0, n + 1)
    bears = lambda i, start, size: max(0, start + size - max(start, int(n[i] - loss[i])))
    for limits in (packing.Limits(), packing.Limits(256, 5, 90), packing.Limits(512, 16, 512, min_cut=0)):
        use, seen = defaultdict(lambda: [0, 0, 0]), defaultdict(int)
        for i, start, size, b, off in sorted(packing.pack(n, loss, limits), key=lambda x: (x[0], x[1])):
            assert start == seen[i] and size > 0
            seen[i] += size
        for i, start, size, b, off in sorted(packing.pack(n, loss, limits), key=lambda x: (x[3], x[4])):
            assert off == use[b][0]
            use[b][0] += size
            use[b][1] += 1
            use[b][2] += bears(i, start, size)
        assert [seen[i] for i in range(len(n))] == n.tolist()
        assert all(a <= limits.tokens and s <= limits.segments and m <= limits.loss for a, s, m in use.values())
    n = n[:560]  # without the hundreds of one-token documents, which the segment limit spreads
    full = packing.pack(n, n, packing.Limits())
    assert n.sum() / (2048 * (1 + max(x[3] for x in full))) > 0.98


def test_op2(spark):
    d = "/root/testdata/sf0.001"
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 1] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    seen, seqs = defaultdict(int), defaultdict(int)
    rows = Q.op2_packing(spark, d).collect()
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        seen[r.doc_id] += r.length
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == seqs[r.sequence_id]
        seqs[r.sequence_id] += r.length
    assert seen == {k: len(v) for k, v in ids.items()} and max(seqs.values()) <= 2048
