"""Repeated substrings over a corpus: the front end that suffix.py and automaton.py share.

A window (a fixed number of symbols, bytes or words, of one document) is a repeat if the same
window starts earlier: in a smaller document id, or earlier in the same document. To find all
repeats without comparing all positions:

1. Every window owns an anchor, the least-hashed k-gram in it. Equal windows own equal
   anchors, so windows whose anchor's hash occurs once in the corpus are settled: no repeat.
   Neighbouring windows of one anchor form a run, about two runs per window length.
2. Runs are interned: runs equal in content (c) are one variant, represented by the first
   document that holds it; all other holders are repeats as a whole.
3. Only keys with several variants are left: boundaries of copied passages. Their texts are
   fetched and handed, all variants of a key together, to the method of the caller, which
   orders or scans them and reports the windows that an earlier variant holds.
4. A key with more than `hot` variants (a common passage in different surroundings) is split:
   each of its windows becomes a key of its own, combined on the map side.

Documents: id may be null (before all ids, returned as null); a null or empty text has no symbols;
rows that repeat an id and its text count as one document listed twice, while every row without an id
is a document; documents of one id, and those without, are in the order of a hash of their texts;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm import kernels as K
from sparkloom.util import Scratch

LEAST = -(2**63)
RUNS = "h long, c long, doc long, pos long, n int, off int"
PARTS = "key long, doc long, pos long, n int, off int, ctx binary"


@dataclass(frozen=True)
class Kind:
    """What a symbol is: bytes, or words by 64-bit hashes of their bytes."""

    unit: str
    window: int
    k: int
    hot: int = 512
    block: int = 1 << 20

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint64 symbols for hashing and their row offsets."""
        if self.unit == "bytes":
            return K.BYTE[data], offsets
        hashes, _, _, at = K.words(data, offsets)
        return hashes, at

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as they are compared in the end: bytes, or hashes of words."""
        return (data, offsets) if self.unit == "bytes" else self.symbols(data, offsets)


def _parts(batch: pa.RecordBatch, text: int, limit: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = K.buffers(batch.column(text))
    for i, j in K.blocks(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def find_runs(kind: Kind) -> Callable:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, offsets in _parts(batch, 1, kind.block):
                a = K.anchors(*kind.symbols(data, offsets), kind.window, kind.k)
                doc = ids[i:][a["row"]]
                # a run's later copies in one document are repeats already: no c, key or count for them
                order = np.lexsort((a["start"], a["c"], a["h"], a["row"]))
                same = np.zeros(len(order), bool)
                if len(order):
                    x, y = order[1:], order[:-1]
                    same[x] = (a["row"][x] == a["row"][y]) & (a["h"][x] == a["h"][y]) & (a["c"][x] == a["c"][y])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a["h"].view(np.int64), mask=same), pa.array(a["c"].view(np.int64), mask=same), pa.array(doc), pa.array(a["start"]), pa.array(a["count"].astype(np.int32)), pa.array(a["off"].astype(np.int32))],
                    names=["h", "c", "doc", "pos", "n", "off"],
                )

    return run


def fetch(kind: Kind) -> Callable:
    """(doc, text, want) -> the symbols of the wanted runs; of hot keys, each window by itself."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            want = batch.column(2)
            fields = want.flatten()
            key, pos, n, off = (f.to_numpy(zero_copy_only=False) for f in (fields.field(x) for x in ("h", "pos", "n", "off")))
            hot = fields.field("hot").to_numpy(zero_copy_only=False)
            per = np.diff(want.offsets.to_numpy())
            edge = np.append(0, np.cumsum(per))
            for i, j, data, offsets in _parts(batch, 1, kind.block):
                sym, at = kind.raw(data, offsets)
                lo, hi = edge[i], edge[j]
                row = np.repeat(np.arange(j - i), per[i:j])
                size = sym.itemsize
                flat, start = sym.tobytes(), at[row] + pos[lo:hi]
                cold = np.flatnonzero(~hot[lo:hi])
                if len(cold):
                    ctx = [flat[s * size : (s + m + kind.window - 1) * size] for s, m in zip(start[cold].tolist(), n[lo:hi][cold].tolist(), strict=True)]
                    yield _part(key[lo:hi][cold], ids[i:][row[cold]], pos[lo:hi][cold], n[lo:hi][cold], off[lo:hi][cold], ctx)
                if len(cold) < hi - lo:
                    warm = np.flatnonzero(hot[lo:hi])
                    many = n[lo:hi][warm].astype(np.int64)
                    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    s = np.repeat(start[warm], many) + step
                    p = K.prefix(kind.symbols(data, offsets)[0])
                    h = K.mix(K.slices(p, s, s + kind.window))
                    doc, place = np.repeat(ids[i:][row[warm]], many), np.repeat(pos[lo:hi][warm], many) + step
                    order = np.lexsort((place, doc, h))
                    first = np.concatenate(([True], h[order][1:] != h[order][:-1]))
                    head = order[first][np.cumsum(first) - 1]  # a row listed twice is no earlier copy of itself
                    later = order[~first & ((doc[head] != doc[order]) | (place[head] != place[order]))]
                    if len(later):
                        yield _part(h.view(np.int64)[later], doc[later], place[later], np.ones(len(later)), np.zeros(len(later)), [None] * len(later))
                    x = order[first]
                    yield _part(h.view(np.int64)[x], doc[x], place[x], np.ones(len(x)), np.zeros(len(x)), [flat[q * size : (q + kind.window) * size] for q in s[x].tolist()])

    return run


def _part(key, doc, pos, n, off, ctx) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(doc), pa.array(np.asarray(pos, np.int64)), pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(off, np.int32)), pa.array(ctx, pa.binary())],
        names=["key", "doc", "pos", "n", "off", "ctx"],
    )


def by_key(method: Callable, rows: int = 20_000) -> Callable:
    """Run method over sorted rows in chunks that hold whole keys; method gets columns as numpy and yields (doc, pos, n)."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(t: pa.Table):
            key, doc, pos, n, off = (t.column(i).to_numpy() for i in range(5))
            d, p, m = method(key, doc, pos, n.astype(np.int64), off.astype(np.int64), t.column(5).to_pylist())
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(d, np.int64)), pa.array(np.asarray(p, np.int64)), pa.array(np.asarray(m, np.int32))], names=["doc", "pos", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, rows):
                held.append(batch.slice(i, rows))
                t = pa.Table.from_batches(held)
                keys = t.column(0).to_numpy()
                cut = int(np.searchsorted(keys, keys[-1], "left"))  # keys ascend: the last may go on
                if cut and t.num_rows >= rows:
                    yield flush(t.slice(0, cut).combine_chunks())
                    held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).combine_chunks())

    return run


def cut_out(kind: Kind, whole: bool = False, carried: tuple = ()) -> Callable:
    """(id, text, spans of repeated windows, carried columns) -> what is left and counts.

    whole: of bytes, a character that loses a byte goes as a whole, so that what is left is UTF-8.
    """

    def run(batches):
        for batch in batches:
            ids, spans = batch.column(0), batch.column(2)
            fields = spans.flatten()
            pos, n = fields.field("pos").to_numpy(zero_copy_only=False), fields.field("n").to_numpy(zero_copy_only=False)
            lens = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            edge = np.append(0, np.cumsum(lens))
            for i, j, data, offsets in _parts(batch, 1, kind.block):
                if kind.unit == "bytes":
                    at, start, end = offsets, None, None
                else:
                    _, start, end, at = K.words(data, offsets)
                total = int(at[-1])
                lo, hi = edge[i], edge[j]
                row = np.repeat(np.arange(j - i), lens[i:j])
                s = at[row] + pos[lo:hi]
                m = np.minimum(n[lo:hi], at[row + 1] - kind.window + 1 - s)
                e = np.where(m > 0, s + m + kind.window - 1, s)
                delta = np.zeros(total + 1, np.int64)
                np.add.at(delta, s, 1)
                np.add.at(delta, e, -1)
                gone = np.cumsum(delta[:total]) > 0
                if whole and kind.unit == "bytes" and total:
                    char = np.cumsum((data & 0xC0) != 0x80) - 1
                    gone = (np.bincount(char, gone, int(char[-1]) + 1) > 0)[char]
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                first = at[:-1][at[:-1] < at[1:]]
                head[first] = gone[first]
                cum, heads = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(head))
                removed, n_spans = cum[at[1:]] - cum[at[:-1]], heads[at[1:]] - heads[at[:-1]]
                if kind.unit == "bytes":
                    kept_bytes, bounds = data[~gone], at - cum[at]
                else:
                    keep = ~gone
                    mask = np.zeros(len(data) + 1, np.int64)
                    np.add.at(mask, start[keep], 1)
                    np.add.at(mask, end[keep], -1)
                    out = np.where(np.cumsum(mask[:-1]) > 0, data, 32)
                    stay = np.cumsum(mask[:-1]) > 0
                    # one space between kept words: the byte after each kept word but a row's last
                    kept_ids = np.flatnonzero(keep)
                    rows_of = np.searchsorted(at, kept_ids, "right") - 1
                    inner = kept_ids[:-1][rows_of[:-1] == rows_of[1:]] if len(kept_ids) else kept_ids
                    stay[end[inner]] = True
                    kept_bytes, cs = out[stay].astype(np.uint8), np.append(0, np.cumsum(stay))
                    bounds = cs[offsets]
                raw = kept_bytes.tobytes()
                kept = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(at[1:] - at[:-1]), pa.array(removed), pa.array(n_spans), kept, *(batch.column(3 + c).slice(i, j - i) for c in range(len(carried)))], names=["doc_id", "n_symbols", "n_removed", "n_spans", "kept", *carried])

    return run


def with_keys(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with doc, a key in the order of documents, and copy: null at the row that stands for a document.

    copy is false in a row listed twice, true in a row without an id whose text an earlier such row has.
    An id is its own key, unless some id is null or has several texts: then all keys are dealt out anew.
    """
    body = F.xxhash64("text")
    odd = docs.groupBy("doc_id").agg(F.min(body).alias("a"), F.max(body).alias("b")).filter(f"a <> b or doc_id is null or doc_id = {LEAST}")
    if odd.isEmpty():
        return docs.select("*", F.col("doc_id").alias("doc"), F.lit(None).cast("boolean").alias("copy"))
    rows = scratch.keep(docs.select("*", body.alias("body"), F.monotonically_increasing_id().alias("at")))
    heads = rows.groupBy("doc_id", "body").agg(F.min("at").alias("head"))
    keys = scratch.keep(heads.orderBy(F.asc_nulls_first("doc_id"), "body").select(F.col("doc_id").alias("id"), F.col("body").alias("hash"), "head", F.monotonically_increasing_id().alias("doc")))
    copy = F.when(F.col("at") > F.col("head"), F.col("doc_id").isNull())
    out = scratch.keep(rows.join(keys, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("body") == F.col("hash"))).select(*docs.columns, "doc", copy.alias("copy")))
    scratch.drop(rows, keys)
    return out


def remove_repeats(docs: DataFrame, kind: Kind, method: Callable, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", method_rows: int = 20_000, whole: bool = False, carry: tuple = ()) -> DataFrame:
    """(doc_id, n_symbols, n_removed, n_spans, kept) and the columns named in carry, as c0, c1, ..., for every row of docs."""
    names = tuple(f"c{i}" for i in range(len(carry)))
    all_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    all_ = with_keys(all_, scratch)
    keyed = all_.filter("copy is null").select("doc", "text")
    runs = scratch.keep(keyed.mapInArrow(K.returning(find_runs(kind)), RUNS))
    stats = runs.filter("h is not null").groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("doc").alias("first"), F.min("c").alias("c1"), F.max("c").alias("c2")).filter("m > 1").drop("m")
    shared = scratch.keep(runs.join(stats, "h").filter("c1 <> c2 or doc > first").select("h", "c", "doc", "pos", "n", "off", (F.col("c1") != F.col("c2")).alias("several")))
    own = scratch.keep(runs.filter("h is null").select("doc", "pos", "n"))
    scratch.drop(runs)
    alone = shared.filter("not several").select("doc", "pos", "n")
    mixed = shared.filter("several")
    variants = scratch.keep(mixed.groupBy("h", "c").agg(F.min("doc").alias("doc"), F.min_by("pos", "doc").alias("pos"), F.min("n").alias("n"), F.min("off").alias("off")))
    copies = mixed.join(variants.select("h", "c", F.col("doc").alias("first")), ["h", "c"]).filter("doc > first").select("doc", "pos", "n")
    busy = variants.groupBy("h").agg(F.count(F.lit(1)).alias("m"))
    want = variants.join(busy, "h").filter("m > 1").groupBy("doc").agg(F.collect_list(F.struct("h", "pos", "n", "off", (F.col("m") > kind.hot).alias("hot"))).alias("want"))
    parts = scratch.keep(keyed.join(want, "doc").mapInArrow(K.returning(fetch(kind)), PARTS))
    settled = parts.filter("ctx is null").select("doc", "pos", "n")
    open_ = parts.filter("ctx is not null")
    n_parts = int(all_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = open_.repartition(n_parts, "key").sortWithinPartitions("key", "doc", "pos").mapInArrow(K.returning(by_key(method, method_rows)), "doc long, pos long, n int")
    spans = own.union(alone).union(copies).union(settled).union(found).groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    # a copy without an id: every window of it starts earlier
    whole_text = F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(2**31 - 1).alias("n")))
    joined = all_.join(spans, "doc", "left").select("doc_id", "text", F.when(F.col("copy"), whole_text).otherwise(F.col("spans")).alias("spans"), *names)
    more = "".join(f", {n} {all_.schema[n].dataType.simpleString()}" for n in names)
    return joined.mapInArrow(K.returning(cut_out(kind, whole, names)), "doc_id long, n_symbols long, n_removed long, n_spans long, kept binary" + more)
