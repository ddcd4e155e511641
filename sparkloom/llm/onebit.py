"""Nearest neighbours by largest inner product from randomly rotated one-bit codes (operator 12).

A point's offset from its cell's centroid is turned by a random rotation and kept as its signs (a bit
a component), with three correction scalars: its length, the cosine between offset and code, and the
product with the centroid. A task unpacks the codes of its split, estimates all products with its queries,
and knows how far an estimate may be off: `error` standard deviations of the angle that the rotation leaves
open. Vectors whose upper bound reaches both the query's floor (from the sample) and the k-th best lower bound are
ranked again by the exact product. No cell that could hold a nearer vector is left out, so only estimates beyond
the bound lose neighbours (recall in the tests: 1.0 at `error` = 4).

Results: vectors that are null, empty, zero, hold null or non-finite components, or whose squared length is
not finite, and rows without an id take no part. Equal rows (id and vector) count once; of an id with several
vectors, each is a query and a candidate, and never an answer to its own id. Vectors of different
lengths are not compared.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm import cells as C
from sparkloom.util import Scratch

FOUND = "query long, point long, least_id long, score double"
STEP = 256  # queries that a task estimates at once


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng(7 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centroid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed signs, cosine between offset and code, product with the centroid) of vectors of one cell."""
    dim = x.shape[1]
    offset = x - centroid
    length = np.sqrt((offset * offset).sum(1))
    turned = (offset / np.where(length > 0, length, 1)[:, None]) @ rotation(dim).T
    fit = np.where(length > 0, np.abs(turned).sum(1) / np.sqrt(dim), 1.0)
    return np.packbits(turned > 0, axis=1), fit, x @ centroid


def estimate(codes: np.ndarray, length: np.ndarray, fit: np.ndarray, along: np.ndarray, centroid: np.ndarray, queries: np.ndarray, error: float) -> tuple[np.ndarray, np.ndarray]:
    """(estimated products, how far they may be off) of queries with coded points."""
    dim = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1
    offset = queries - centroid
    norm = np.sqrt((offset * offset).sum(1))
    turned = ((offset / np.where(norm > 0, norm, 1)[:, None]) @ rotation(dim).T).astype(np.float32)
    scale = (norm[:, None] * length[None, :]).astype(np.float32)
    guess = turned @ signs.T
    guess *= (1 / (np.sqrt(dim) * fit)).astype(np.float32)
    guess *= scale
    guess += along.astype(np.float32)
    guess += (queries @ centroid - centroid @ centroid)[:, None].astype(np.float32)
    off = scale * (np.sqrt(np.maximum(0, 1 - fit**2)) / fit * error / np.sqrt(max(dim - 1, 1))).astype(np.float32)
    off += np.float32(1e-5) * (1 + np.abs(guess))  # single precision
    return guess, off


def exact(x: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products in double precision, summed in the order of the components."""
    return np.cumsum(x * query, axis=1)[:, -1] + 0.0


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & (F.size(v) > 0))
    fine = F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda a, e: a + e * e)
    return rows.filter(fine & F.exists(v, lambda e: e != 0) & (F.coalesce(square, F.lit(0.0)) < float("inf")))


def nearest(vectors: DataFrame, is_query: Column, scratch: Scratch, k: int = 20, error: float = 4.0, id_col: str = "vec_id", vec_col: str = "embedding", cell: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which is_query (a condition on `id`) holds."""
    rows = usable(vectors, id_col, vec_col)
    bare = scratch.keep(rows.select("id", F.lit(None).cast("long").alias("label"), "v").mapInArrow(C.packed, "id long, label long, x binary"))
    points = C.distinct(bare, k + 1, scratch)
    dealt, cells = C.deal(points, scratch, cell)
    centroids = {n: c for ks, cs in cells.centroids.values() for n, c in zip(ks.tolist(), cs, strict=True)}

    def coded(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            code, fit, along = [None] * len(f), np.ones(len(f)), np.zeros(len(f))
            for home, at in f.groupby("home").indices.items():
                x = C.matrix(f["x"].to_numpy()[at])
                bits, fit[at], along[at] = encode(x, centroids.get(home, np.zeros(x.shape[1])))
                for i, b in zip(at.tolist(), bits, strict=True):
                    code[i] = b.tobytes()
            f["code"], f["fit"], f["along"] = code, fit, along
            yield f

    schema = dealt.withColumn("code", F.lit(b"")).withColumn("fit", F.lit(0.0)).withColumn("along", F.lit(0.0)).schema
    index = scratch.keep(dealt.mapInPandas(coded, schema))
    asked = bare.filter(is_query).select(F.col("id").alias("query_id"), "x").distinct().join(points.select("x", F.col("point").alias("query")), "x").select("query_id", "query")
    asked = scratch.keep(asked)
    queries = asked.select("query").distinct().join(points.select(F.col("point").alias("query"), "label", "dim", "x"), "query")

    def bound(frame, x, labels, sample):
        least = C.kth(x @ sample.T, k + 1)
        return (least - 1e-9 * (1 + np.abs(np.nan_to_num(least, neginf=0))))[:, None].tolist(), np.full(len(x), np.inf)

    def compare(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, y = C.matrix(p["x"]), C.matrix(q["x"])
        codes = np.frombuffer(b"".join(p["code"]), np.uint8).reshape(len(p), -1)
        length, fit, along, ids = (p[c].to_numpy() for c in ("far", "fit", "along", "least_id"))
        centroid = centroids.get(p["home"].iat[0], np.zeros(x.shape[1]))
        floors = np.array([f[0] for f in q["floors"]])
        out = []
        for s in range(0, len(y), STEP):
            guess, off = estimate(codes, length, fit, along, centroid, y[s : s + STEP], error)
            least = np.maximum(floors[s : s + STEP], C.kth(guess - off, k + 1))
            for i, j in enumerate(guess + off >= least[:, None].astype(np.float64)):
                near = np.flatnonzero(j)
                score = exact(x[near], y[s + i])
                good = score >= floors[s + i]
                near, score = near[good], score[good]
                pick = C.firsts(np.zeros(len(near), int), score, ids[near], k + 1)
                out.append((np.full(len(pick), s + i), near[pick], score[pick]))
        at, near, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query": q["query"].to_numpy()[at], "point": p["point"].to_numpy()[near], "least_id": ids[near], "score": score})

    routed = C.route(queries, cells, bound, scratch)
    found = scratch.keep(C.search(index, routed, cells, compare, FOUND))
    hits = C.top(found, points, ["query"], k + 1)
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return asked.join(hits, "query").select("query_id", F.posexplode(own).alias("place", "hit")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), (F.lit(0.0) - F.col("hit.minus")).alias("score"))
