"""Hard negatives by bit-sliced integer products (operator 13).

A row's score for an anchor is the integer inner product of their components. An anchor's positives are the
best other rows of its label; of each positive, negatives are the best rows of other labels whose score lies
between two percentages of the positive's.

A task cuts its points' components into bit planes and adds up the anchors' products with them, the most
significant plane first. What the planes to come can add lies between the sums of an anchor's negative and of its
positive components, times what their bits can make, so every score has an interval that halves with each
plane. A point whose interval cannot reach a range that is asked for, or lies below the floor of each (the k-th best
score of the sample; then the k-th best lower end within the task), is dropped. Few points are left when the
low planes come, and those are added up pair by pair.

Results: rows without id or label, with a null vector or a null or non-finite component take no part; a vector
without components neither. Equal rows count once. An id with several vectors or labels has each of them as a row; it is
no positive of itself, but may be its negative. Vectors of different lengths are not compared. Scores are
exact as long as the absolute components of an anchor sum to less than 2^53 and scores stay below it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.llm import cells as C
from sparkloom.util import Scratch

FOUND = "query long, slot int, point long, least_id long, score double"
STEP = 256  # anchors that a task takes at once
PAIRS = 1 << 16  # pairs whose products are added up at once


def sliced(anchors: np.ndarray, points: np.ndarray, allowed: np.ndarray, floors: np.ndarray, highs: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, range, point, score): of each anchor and range the k best allowed points with floor <= score <= high.

    anchors, points: whole numbers as doubles; floors, highs: by anchor and range (an empty range has floor inf).
    """
    low = points.min() if points.size else 0.0
    bits = (points - low).astype(np.int64)
    planes = max(1, int(bits.max()).bit_length()) if bits.size else 1
    up, down = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    kind = np.float32 if np.abs(anchors).sum(1).max(initial=0) < 2**24 else np.float64
    part = np.repeat((low * anchors.sum(1))[:, None], len(points), 1)
    alive, plane, some = allowed.copy(), planes, anchors.astype(kind)
    least, most = floors.min(1), highs.max(1)
    while plane and np.count_nonzero(alive) > alive.size // 16:  # whole planes while many points are alive
        plane -= 1
        part += (some @ (bits >> plane & 1).astype(kind).T).astype(np.float64) * float(1 << plane)
        rest = float((1 << plane) - 1)
        alive &= (part >= (least - rest * up)[:, None]) & (part <= (most - rest * down)[:, None])
    a, p = np.nonzero(alive)
    score = part[a, p]
    floors = floors.copy()
    while True:
        rest = float((1 << plane) - 1)
        high, lower = score + rest * up[a], score + rest * down[a]
        hit = np.zeros(len(a), bool)
        for w in range(floors.shape[1]):
            inside = np.flatnonzero((lower >= floors[a, w]) & (high <= highs[a, w]))
            best = C.firsts(a[inside], lower[inside], ids[p[inside]], k)
            who, many = np.unique(a[inside][best], return_counts=True)
            full = inside[best][np.isin(a[inside][best], who[many == k])]
            if len(full):  # k points are surely as good as the worst of these
                np.maximum.at(floors[:, w], who[many == k], np.minimum.reduceat(lower[full], np.arange(0, len(full), k)))
            hit |= (high >= floors[a, w]) & (lower <= highs[a, w])
        a, p, score = a[hit], p[hit], score[hit]
        if not plane:
            break
        plane -= 1
        for s in range(0, len(a), PAIRS):
            t = slice(s, s + PAIRS)
            score[t] += (anchors[a[t]] * (bits[p[t]] >> plane & 1)).sum(1) * float(1 << plane)
    out = []
    for w in range(floors.shape[1]):
        inside = np.flatnonzero((score >= floors[a, w]) & (score <= highs[a, w]))
        best = inside[C.firsts(a[inside], score[inside], ids[p[inside]], k)]
        out.append((a[best], np.full(len(best), w), p[best], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _compare(same: bool, k: int):
    def compare(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, y, ids = C.matrix(p["x"]), C.matrix(q["x"]), p["least_id"].to_numpy()
        ours, theirs = p["label"].to_numpy(), q["label"].to_numpy()
        width = max(map(len, q["floors"]))
        floors, highs = np.full((len(q), width), np.inf), np.full((len(q), width), -np.inf)
        for i, (f, h) in enumerate(zip(q["floors"], q["highs"], strict=True)):
            floors[i, : len(f)], highs[i, : len(h)] = f, h
        out = []
        for s in range(0, len(q), STEP):
            t = slice(s, s + STEP)
            a, w, at, score = sliced(y[t], x, (theirs[t, None] == ours[None, :]) == same, floors[t], highs[t], ids, k)
            out.append((a + s, w, at, score))
        a, w, at, score = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query": q["query"].to_numpy()[a], "slot": w.astype(np.int32), "point": p["point"].to_numpy()[at], "least_id": ids[at], "score": score})

    return compare


def _bound(same: bool, k: int):
    """Floors from the sample: the k-th best score in a range, or the range's own end."""

    def bound(frame, x, labels, sample):
        own, most = [], np.empty(len(x))
        for s in range(0, len(x), STEP):
            score = x[s : s + STEP] @ sample.T
            fits = (frame["label"].to_numpy()[s : s + STEP, None] == labels[None, :]) == same
            for i in range(len(score)):
                lows, highs = frame["lows"].iat[s + i], frame["highs"].iat[s + i]
                most[s + i] = max(highs)
                floors = []
                for low, high in zip(lows, highs, strict=True):
                    there = score[i][fits[i] & (score[i] >= low) & (score[i] <= high)]
                    floors.append(max(low, float(C.kth(there[None, :], k)[0])))
                own.append(floors)
        return own, most

    return bound


def hard_negatives(rows: DataFrame, is_anchor: Column, scratch: Scratch, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, cell: int = 4096) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v).

    v: an array of whole numbers; is_anchor: a condition on `id`. Negatives: low * positive score <= 100 * score <= high * positive score.
    """
    v = F.col("v")
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & (F.abs(e) < float("inf")))
    known = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<double>")).filter(F.coalesce(fine, F.lit(False)))
    bare = scratch.keep(known.mapInArrow(C.packed, "id long, label long, x binary"))
    points = C.distinct(bare, max(positives + 1, negatives), scratch)
    dealt, cells = C.deal(points, scratch, cell)
    asked = bare.filter(is_anchor).select(F.col("id").alias("anchor_id"), "label", "x").distinct().join(points.select("label", "x", F.col("point").alias("query")), ["label", "x"]).select("anchor_id", "query")
    asked = scratch.keep(asked)
    anchors = scratch.keep(asked.select("query").distinct().join(points.select(F.col("point").alias("query"), "label", "dim", "x"), "query"))
    one = lambda x: F.array(F.lit(x))
    routed = C.route(anchors.withColumn("lows", one(float("-inf"))).withColumn("highs", one(float("inf"))), cells, _bound(True, positives + 1), scratch)
    found = C.search(dealt, routed, cells, _compare(True, positives + 1), FOUND, ("highs",))
    hits = scratch.keep(C.top(found, points, ["query"], positives + 1))
    # a range for each distinct score among the hits: what the positives of any of their anchors can need
    zero = F.lit(0.0)
    scores = F.array_sort(F.array_distinct(F.transform("hits", lambda h: zero - h["minus"])))
    ranges = hits.select("query", F.filter(scores, lambda s: s * low <= s * high).alias("scores")).filter(F.size("scores") > 0)
    ranges = ranges.withColumn("lows", F.transform("scores", lambda s: s * low / 100)).withColumn("highs", F.transform("scores", lambda s: s * high / 100))
    routed = C.route(anchors.join(ranges, "query"), cells, _bound(False, negatives), scratch)
    found = scratch.keep(C.search(dealt, routed, cells, _compare(False, negatives), FOUND, ("highs",)))
    worse = C.top(found, points, ["query", "slot"], negatives).select("query", "slot", F.col("hits").alias("negatives"))
    own = F.slice(F.filter("hits", lambda h: h["id"] != F.col("anchor_id")), 1, positives)
    better = asked.join(hits, "query").join(ranges.select("query", "scores"), "query").select("anchor_id", "query", "scores", F.explode(own).alias("hit"))
    better = better.select("anchor_id", "query", F.col("hit.id").alias("positive_id"), (zero - F.col("hit.minus")).alias("score"), (F.array_position("scores", zero - F.col("hit.minus")) - 1).cast("int").alias("slot"))
    out = better.join(worse, ["query", "slot"]).select("anchor_id", "positive_id", "score", F.posexplode("negatives").alias("place", "hit"))
    whole = lambda c: c.cast("long")
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("negative_id"), whole(F.col("score")).alias("positive_score"), whole(zero - F.col("hit.minus")).alias("negative_score"))
