"""Exhaustive vector search in bounded blocks, shared by operators 12 and 13.

Points are distinct vectors with the smallest ids that hold them, so a group of copies is one point however large it
is. Points are dealt to cells: the nearest of at most `most` centroids, k-means on a bounded sample (`sample` points
of least hash; it only places points, every point is searched). A cell of more than `cell` points is split by
hash. A query goes to each cell that can hold what it asks for: from its product with the centroid
and the cell's radius, against a threshold that the sample gives. Every task compares at most a
split of a cell with a chunk of its queries; both sides are dealt by Spark and neither is collected.

On vectors without cluster structure no cell can be left out; then the work is the product of points and queries.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.util import Scratch

#: Queries of a task.
CHUNK = 4096


@dataclass
class Cells:
    """Centroids (by number of components), and of each cell its points, splits and radius."""

    centroids: dict[int, tuple[np.ndarray, np.ndarray]]  # dim -> (cell numbers, rows of centroids)
    stats: dict[int, tuple[int, int, float]]  # cell -> (points, splits, radius)
    sample: dict[int, tuple[np.ndarray, np.ndarray]]  # dim -> (labels, vectors)


def distinct(rows: DataFrame, keep: int, scratch: Scratch) -> DataFrame:
    """(id, label, x) -> (point, label, dim, x, ids): one row per label and vector, its `keep` smallest ids, point the least.

    The limit on ids comes before the shuffle (a ranking by window with a bound), so large groups of copies stay small.
    """
    order = Window.partitionBy("label", "x").orderBy("id")
    few = rows.dropDuplicates(["label", "x", "id"]).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    one = few.groupBy("label", "x").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # an id may stand for several vectors: points are numbered by the row
    return scratch.keep(one.select(F.monotonically_increasing_id().alias("point"), "label", (F.length("x") / 8).cast("int").alias("dim"), "x", "ids"))


def matrix(column) -> np.ndarray:
    """Rows of doubles from a column of their bytes, all of one length."""
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means by Lloyd's rounds from evenly taken rows; a cell that empties keeps its centroid."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (c @ x.T - (c * c).sum(1)[:, None] / 2).argmax(0)
        many = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[many > 0] = total[many > 0] / many[many > 0, None]
    return c


def deal(points: DataFrame, scratch: Scratch, cell: int = 4096, most: int = 512, sample: int = 16_384) -> tuple[DataFrame, Cells]:
    """Points with `home` (their cell) and `far` (from its centroid), and the cells. Collected: the sample, and three numbers for each cell."""
    spark = points.sparkSession
    taken = points.select("label", "dim", "x").orderBy(F.xxhash64("x"), "label").limit(sample).collect()
    total = points.count()
    centroids, held, n = {}, {}, 0
    for dim in sorted({r.dim for r in taken}):
        rows = [r for r in taken if r.dim == dim]
        x = matrix([r.x for r in rows])
        share = -(-total * len(rows) // len(taken))
        k = max(1, min(most, len(x), -(-share // cell)))
        centroids[dim] = (np.arange(n, n + k), _means(x, k))
        held[dim] = (np.array([np.nan if r.label is None else r.label for r in rows]), x)
        n += k

    def home(batches):
        for b in batches:
            dim, x = b.column(2).to_numpy(), b.column(3)
            cell_of, far = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                v = matrix(x.take(pa.array(at)).to_pylist())
                ks, c = centroids.get(d, (np.array([-d]), np.zeros((1, d))))  # a length that the sample lacks: one cell
                near = (v @ c.T - (c * c).sum(1) / 2).argmax(1)
                cell_of[at] = ks[near]
                far[at] = np.sqrt(((v - c[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell_of), pa.array(far)], names=["point", "label", "dim", "x", "ids", "home", "far"])

    dealt = scratch.keep(points.mapInArrow(home, "point long, label long, dim int, x binary, ids array<long>, home int, far double"))
    stats = {r.home: (r.m, -(-r.m // cell), r.far * (1 + 1e-12) + 1e-9) for r in dealt.groupBy("home").agg(F.count(F.lit(1)).alias("m"), F.max("far").alias("far")).collect()}
    return dealt, Cells(centroids, stats, held)


def route(queries: DataFrame, cells: Cells, bound: Callable, scratch: Scratch) -> DataFrame:
    """Queries (dim, x, ...) with `floors` and `homes`, the cells they go to.

    bound(frame, x, labels, vectors of the sample) gives for each query the list of its floors (a query may ask for
    several ranges of products, and wants nothing below the floor of each) and the greatest product it wants.
    """
    schema = queries.withColumn("floors", F.array().cast("array<double>")).withColumn("homes", F.array().cast("array<int>")).schema
    centroids, stats, sample = cells.centroids, cells.stats, cells.sample

    def send(frames):
        for f in frames:
            f = f.reset_index(drop=True)
            homes, floors = [None] * len(f), [None] * len(f)
            for dim, at in f.groupby("dim").indices.items():
                x = matrix(f["x"].to_numpy()[at])
                labels, vectors = sample.get(dim, (np.zeros(0), np.zeros((0, dim))))
                own, most = bound(f.iloc[at], x, labels, vectors)
                least = np.array([min(o) for o in own])
                ks, c = centroids.get(dim, (np.array([-dim]), np.zeros((1, dim))))
                there = np.array([k in stats for k in ks.tolist()], bool)
                ks, c = ks[there], c[there]
                radius = np.array([stats[k][2] for k in ks.tolist()])
                middle = x @ c.T
                slack = np.sqrt((x * x).sum(1))[:, None] * radius[None, :] + 1e-9 * (1 + np.abs(middle))
                go = (middle + slack >= least[:, None]) & (middle - slack <= most[:, None])
                for i, g, o in zip(at.tolist(), go, own, strict=True):
                    homes[i], floors[i] = ks[g].tolist(), [float(y) for y in o]
            f["floors"], f["homes"] = floors, homes
            yield f

    return scratch.keep(queries.mapInPandas(send, schema))


def search(dealt: DataFrame, queries: DataFrame, cells: Cells, compare: Callable, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """compare(points, queries) of every split of a cell with every chunk of the queries sent to it.

    carry: columns of the queries that compare needs besides query, label, x and floors.
    """
    asked = queries.select(F.explode("homes").alias("home"), "query", "label", "x", "floors", *carry)
    # the rows of `bounds` are cells: at most `most` of them
    many = {r.home: max(1, -(-r.m // CHUNK)) for r in asked.groupBy("home").agg(F.count(F.lit(1)).alias("m")).collect()}
    bounds = F.broadcast(dealt.sparkSession.createDataFrame([(h, n, cells.stats[h][1]) for h, n in many.items()], "home int, chunks int, splits int"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    ours = [c for c in dealt.columns if c not in ("home", "dim", "ids")]
    left = dealt.withColumn("least_id", F.element_at("ids", 1)).join(bounds, "home").select("home", part("point", "splits").alias("shard"), each("chunks").alias("chunk"), "least_id", *ours)
    right = asked.join(bounds, "home").select("home", each("splits").alias("shard"), part("query", "chunks").alias("chunk"), "query", "label", "x", "floors", *carry)
    keys, names = ["home", "shard", "chunk"], [c.split()[0] for c in schema.split(", ")]

    def task(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return compare(p, q) if len(p) and len(q) else pd.DataFrame({c: [] for c in names})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, schema)


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; -inf where a row has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def firsts(group: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each group, ties by the smaller id."""
    order = np.lexsort((ids, -scores, group))
    head = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1])) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[place < k]


def top(found: DataFrame, points: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each key from the best points of all tasks: array `hits` of (minus score, id), best first."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "least_id")
    few = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).select(*by, "point", "score")
    hit = F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("id"))))
    rows = few.join(points.select("point", "ids"), "point").select(*by, hit.alias("hit"))
    return rows.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("hit")), 1, k).alias("hits"))


def packed(batches):
    """(id, label, array of doubles) -> (id, label, x): the doubles' bytes."""
    for b in batches:
        offsets = b.column(2).offsets.to_numpy().astype(np.int64) * 8
        flat = b.column(2).values.to_numpy(zero_copy_only=False) + 0.0  # no negative zero
        x = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], names=["id", "label", "x"])
