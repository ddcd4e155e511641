"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios (operator 1).

Features are hashed character n-grams of the lower-cased text (white space counts as one kind of
character, texts are framed by it); a document has each feature once or not at all. Each feature is
scaled by its log-count ratio between toxic and clean training documents, and logistic regression
with an L2 penalty weights them. The intercept is moved from the classes' shares in the sample to
their shares among all training rows, so the score is a probability.

Training reads a bounded sample: `per_class` labelled documents of each class, of least id hash.
Scoring reads every whole text in one pass without a shuffle.

Results: one row per row of docs, score from 0 to 1. A null or empty text is scored as an empty one.
Without labels of both classes every score is the share of toxic rows (0 without any). Repeated
labels of one document count once, toxic if any says so; null labels are not used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.llm.kernels import returning
from sparkloom.llm.tokens import text_blocks
from sparkloom.util import Scratch

BITS = 20
ORDERS = (4, 5, 6)


def _positions(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of all n-grams of framed, lower-cased texts."""
    framed = ["  " + (t or "").lower() + "  " for t in texts]
    lens = np.fromiter(map(len, framed), np.int64, len(framed))
    c = np.frombuffer("".join(framed).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    c[(c >= 9) & (c <= 13)] = 32
    row = np.repeat(np.arange(len(framed)), lens)
    buckets, rows = [], []
    h = c
    for n in range(2, max(ORDERS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in ORDERS:
            inside = row[: len(h)] == row[n - 1 :]
            b = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)
            buckets.append(b[inside].astype(np.int64))
            rows.append(row[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(rows)


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray  # of the scaled features
    bias: float

    def table(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return out


def present(texts: list[str | None], table: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs, each once."""
    b, row = _positions(texts)
    f = table[b]
    hit = np.flatnonzero(f >= 0)
    pair = np.unique(row[hit] * max(k, 1) + f[hit])
    return pair // max(k, 1), pair % max(k, 1)


def score(texts: list[str | None], model: Model, table: np.ndarray) -> np.ndarray:
    row, f = present(texts, table, len(model.buckets))
    z = model.bias + np.bincount(row, model.weights[f], len(texts)) if len(model.buckets) else np.full(len(texts), model.bias)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, k: int, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Nesterov's gradient descent on the mean log loss, classes weighted alike."""
    n = len(y)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b, v, c = np.zeros(k), 0.0, np.zeros(k), 0.0
    norm = np.bincount(rows, values**2, n) + 1
    rate = 1.0 / (0.25 * (weight * norm).sum() + l2)
    for i in range(rounds):
        z = np.bincount(rows, values * v[cols], n) + c
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        gw, gb = np.bincount(cols, values * g[rows], k) + l2 * v, g.sum()
        w2, b2 = v - rate * gw, c - rate * gb
        m = i / (i + 3)
        v, c = w2 + m * (w2 - w), b2 + m * (b2 - b)
        w, b = w2, b2
    return w, b


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, allowed=None, per_class: int = 1500, features: int = 4000, least: int = 4, alpha: float = 1.0, l2: float = 1e-3, rounds: int = 80, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """allowed: a Column over `doc_id` of the labels that may be learnt from."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    if allowed is not None:
        rows = rows.filter(allowed)
    rows = rows.groupBy("doc_id").agg(F.max("y").alias("y"))
    share = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    if min(share.get(0, 0), share.get(1, 0)) == 0:
        none.bias = 60.0 if share.get(1) else -60.0
        return none
    chosen = [(r.doc_id, r.y) for y in (0, 1) for r in rows.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    picked = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, y int"))  # 2 * per_class rows at most
    sample = scratch.keep(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(picked, "doc_id").select("y", "text"))

    def counts(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for i, texts in text_blocks(batch, 1, 1 << 20):
                b, row = _positions(texts)
                pair = np.unique(row << BITS | b)
                for k in (0, 1):
                    total[k] += np.bincount(pair[y[i:][pair >> BITS] == k] & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(total.any(0))
        for i in range(0, len(at), 100_000):
            x = at[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)), pa.array(total[1, x]), pa.array(total[0, x])], names=["bucket", "p", "q"])

    np_, nq = (sample.filter(F.col("y") == y).count() for y in (1, 0))
    if not np_ or not nq:
        none.bias = float(np.log((share[1] + 0.5) / (share[0] + 0.5)))
        return none
    c = sample.mapInArrow(returning(counts), "bucket int, p long, q long").groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("q").alias("q")).filter(F.col("p") + F.col("q") >= least)
    ratio = F.log((F.col("p") + alpha) / (np_ + 2 * alpha)) - F.log((F.col("q") + alpha) / (nq + 2 * alpha))
    top = c.select("bucket", ratio.alias("r"), (F.abs(F.col("p") / np_ - F.col("q") / nq) * F.abs(ratio)).alias("gain")).orderBy(F.desc("gain"), "bucket").limit(features).collect()
    if not top:
        none.bias = float(np.log((share[1] + 0.5) / (share[0] + 0.5)))
        return none
    top.sort(key=lambda r: r.bucket)
    model = Model(np.array([r.bucket for r in top], np.int64), np.array([r.r for r in top]), 0.0)

    def pairs(batches):
        table = model.table()
        for batch in batches:
            for i, texts in text_blocks(batch, 1, 1 << 20):
                row, f = present(texts, table, len(model.buckets))
                at = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.ListArray.from_arrays(pa.array(at), pa.array(f.astype(np.int32)))], names=["y", "f"])

    got = sorted((r.y, r.f) for r in sample.mapInArrow(returning(pairs), "y int, f array<int>").collect())
    y = np.array([a for a, _ in got])
    lens = np.array([len(f) for _, f in got])
    cols = np.concatenate([np.array(f, np.int64) for _, f in got])
    at, k = np.repeat(np.arange(len(y)), lens), len(model.buckets)

    def fit(use: np.ndarray) -> tuple[np.ndarray, float]:
        """Log-count ratios and weights of the sample's rows in use."""
        pos, neg = use & (y == 1), use & (y == 0)
        p, q = np.bincount(cols[pos[at]], minlength=k), np.bincount(cols[neg[at]], minlength=k)
        r = np.log((p + alpha) / (pos.sum() + 2 * alpha)) - np.log((q + alpha) / (neg.sum() + 2 * alpha))
        of = np.cumsum(use) - 1
        own = use[at]
        w, b = logistic(of[at[own]], cols[own], r[cols[own]], y[use], k, l2, rounds)
        return w * r, b

    # scores of rows that a fold's model has not seen give the slope and intercept of the probability
    fold, z = np.arange(len(y)) % 2, np.zeros(len(y))
    for part in (0, 1):
        if len(set(y[fold != part])) == 2:
            w, b = fit(fold != part)
            mine = fold[at] == part
            z += np.where(fold == part, np.bincount(at[mine], w[cols[mine]], len(y)) + b, 0.0)
    model.weights, model.bias = fit(np.ones(len(y), bool))
    slope, shift = platt(z, y)
    model.weights, model.bias = model.weights * slope, model.bias * slope + shift + float(np.log(share[1] / share[0]))
    return model


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and intercept of the log odds on z, classes weighted alike, by Newton's method with a small penalty."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    x = np.stack((z / (np.abs(z).max() + 1e-9), np.ones(len(z))), 1)
    t = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -40, 40)))
        g = x.T @ (weight * (p - y)) + 1e-5 * t
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-5 * np.eye(2)
        t = t - np.linalg.solve(h, g)
    return max(float(t[0] / (np.abs(z).max() + 1e-9)), 1e-3), float(t[1])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs."""

    def run(batches):
        table = model.table()
        for batch in batches:
            for i, texts in text_blocks(batch, 1, 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), pa.array(score(texts, model, table))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(returning(run), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """Rows of docs that score under the threshold, with all their columns."""
    place = docs.columns.index(text_col)

    def run(batches):
        table = model.table()
        for batch in batches:
            ok = [score(texts, model, table) < threshold for _, texts in text_blocks(batch, place, 1 << 20)]
            yield batch.filter(pa.array(np.concatenate(ok))) if ok else batch

    return docs.mapInArrow(returning(run), docs.schema)
