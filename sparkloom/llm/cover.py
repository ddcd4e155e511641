"""Embedding near-dedup by dual traversal of cover trees (operator 8).

Equal unit vectors of one label are one row with a count first (combined before the shuffle), so a
large group of copies costs one row. Unit vectors of one label are dealt to cells: the nearest of at most `most_pivots` pivots of the
label (rows of least hash; the pivots only place rows, every row is compared). Cells above `cell`
rows are split by hash. Two cells are compared unless their centres lie further apart than both
covering radii and the threshold distance. In each task the cells' cover trees (nested centres,
halving radii, exact covering radii) are traversed together; node pairs out of reach are pruned,
pairs wholly within reach link at once, and leaves are decided by the cosine in double precision.

Results: one row per row of the table. Null or zero vectors, null or non-finite components and null
labels link with nothing; vectors of different lengths never link. Rows that repeat an id, its vector
and its label are one vector listed twice; every other row is a vector of its own, also without an id.
Null ids come before all others and come back as null. Vectors of one id are in the order of a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkloom.operators.components import components
from sparkloom.util import Scratch, with_row_keys


class CoverTree:
    """Nested nets of halving radii; every node knows its exact covering radius.

    Balls of at most `floor` are leaves: below the distance of the threshold bounds part next to no pairs,
    and a leaf's rows are compared by one matrix product.
    """

    def __init__(self, x: np.ndarray, floor: float = 0.02):
        self.x = x
        self.center: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(x):
            self._build(np.arange(len(x)), 2.0, floor)

    def _add(self, center: int, members: np.ndarray) -> int:
        d = np.sqrt(np.maximum(0.0, ((self.x[members] - self.x[center]) ** 2).sum(1)))
        self.center.append(center)
        self.members.append(members)
        self.radius.append(float(d.max()))
        self.children.append([])
        return len(self.center) - 1

    def _build(self, members: np.ndarray, r: float, floor: float) -> None:
        todo = [(self._add(int(members[0]), members), r)]
        while todo:
            node, r = todo.pop()
            members = self.members[node]
            while r > floor and self.radius[node] <= r / 2:  # levels at which the node is its only child
                r /= 2
            if len(members) < 8 or r <= floor:
                continue
            rest, at = members, self.center[node]
            while len(rest):
                d = ((self.x[rest] - self.x[at]) ** 2).sum(1)
                near = d <= (r / 2) ** 2
                near[rest == at] = True
                child = self._add(at, rest[near])
                self.children[node].append(child)
                todo.append((child, r / 2))
                rest = rest[~near]
                at = int(rest[0]) if len(rest) else -1


def dual(a: CoverTree, b: CoverTree | None, cosine: float, emit, emit_all) -> None:
    """All pairs of rows with cosine at least `cosine`, each once; b None: within a.

    emit(i, j): arrays of single pairs; emit_all(i, j): every row of i with every row of j
    (of i alone, each pair of them, if j is None).
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    slack = 1e-9
    same = b is None
    b = a if same else b
    if not a.center or not b.center:
        return
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        if same and p == q:
            if 2 * a.radius[p] <= reach - 1e-7:
                emit_all(a.members[p], None)
                continue
            kids = a.children[p]
            if kids:
                stack += [(k, k) for k in kids]
                c = np.array([a.center[k] for k in kids])
                r = np.array([a.radius[k] for k in kids])
                for i in range(0, len(kids), 256):
                    dot = a.x[c[i : i + 256]] @ a.x[c].T
                    d = np.sqrt(np.maximum(0.0, 2 - 2 * dot))
                    near = d <= r[i : i + 256, None] + r[None, :] + reach + slack
                    u, v = np.nonzero(near)
                    stack += [(kids[i + s], kids[t]) for s, t in zip(u.tolist(), v.tolist(), strict=True) if i + s < t]
                continue
        elif a.children[p] or b.children[q]:
            apart = float(np.sqrt(((a.x[a.center[p]] - b.x[b.center[q]]) ** 2).sum()))
            if apart + a.radius[p] + b.radius[q] <= reach - 1e-7:
                emit_all(a.members[p], b.members[q])
                continue
            first = bool(a.children[p]) and (not b.children[q] or a.radius[p] >= b.radius[q])
            tree, other, node, kids = (a, b, q, a.children[p]) if first else (b, a, p, b.children[q])
            c = np.array([tree.center[k] for k in kids])
            d = np.sqrt(np.maximum(0.0, 2 - 2 * (tree.x[c] @ other.x[other.center[node]])))
            near = d <= np.array([tree.radius[k] for k in kids]) + other.radius[node] + reach + slack
            stack += [(kids[k], q) if first else (p, kids[k]) for k in np.flatnonzero(near).tolist()]
            continue
        i, j = a.members[p], b.members[q]
        for s in range(0, len(i), 512):
            u, v = np.nonzero(a.x[i[s : s + 512]] @ b.x[j].T >= cosine)
            if same and p == q:
                u, v = u[i[s : s + 512][u] < j[v]], v[i[s : s + 512][u] < j[v]]
            if len(u):
                emit(i[s : s + 512][u], j[v])


def unit(vectors: pa.ListArray) -> tuple[np.ndarray, list]:
    """(usable rows, unit vectors in double precision), one matrix for each length of a batch."""
    flat = vectors.values.to_numpy(zero_copy_only=False)  # a null component reads as NaN
    offsets, there = vectors.offsets.to_numpy().astype(np.int64), vectors.is_valid().to_numpy(zero_copy_only=False)
    length = np.where(there, np.diff(offsets), 0)
    rows, out = [], []
    for n in np.unique(length[length > 0]).tolist():
        at = np.flatnonzero(length == n)
        x = flat[offsets[at][:, None] + np.arange(n)].astype(float)
        with np.errstate(over="ignore", invalid="ignore"):
            norm = np.sqrt((x * x).sum(1))
        good = np.isfinite(x).all(1) & (norm > 0) & (norm < np.inf)
        rows.append(at[good])
        out += list(x[good] / norm[good, None])
    return np.concatenate(rows) if rows else np.zeros(0, np.int64), out


def _usable(batches):
    for batch in batches:
        good, xs = unit(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good)), batch.column(1).take(pa.array(good)), pa.array([len(x) for x in xs], pa.int32()), pa.array([x.tobytes() for x in xs], pa.binary())], names=["id", "label", "dim", "x"])


def near_pairs(vectors: DataFrame, scratch: Scratch, cosine: float = 0.98, cell: int = 4096, most_pivots: int = 512, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    spark = vectors.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    keyed = with_row_keys(rows, "vec_id", F.xxhash64("v", "label"), scratch, merge=True)
    rows = rows.select("vec_id", F.col("vec_id").alias("id"), "label", "v") if keyed is None else keyed.select("vec_id", F.col("row_key").alias("id"), "label", "v")
    usable = scratch.keep(rows.filter("label is not null").select("id", "label", "v").dropDuplicates(["id"]).mapInArrow(_usable, "id long, label long, dim int, x binary"))
    # equal vectors link with each other and alike with all else: one of them stands for all, with their number
    single = scratch.keep(usable.groupBy("label", "dim", "x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w")))
    copies = usable.join(single.select("label", "dim", "x", F.col("id").alias("rep"), "w"), ["label", "dim", "x"]).select("id", "rep", "w")
    sizes = single.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("m"))
    want = F.least(F.lit(most_pivots), F.ceil(F.col("m") / cell)).cast("int")
    # pivots: the row of least hash in each of `want` residues of the hash
    slot = F.pmod(F.xxhash64("id"), want).cast("int")
    pivots = [(r.label, r.dim, np.frombuffer(r.x)) for r in single.join(sizes, ["label", "dim"]).groupBy("label", "dim", slot.alias("slot")).agg(F.min_by("x", F.xxhash64("id", F.lit(7))).alias("x")).orderBy("label", "dim", "slot").collect()]
    by: dict = {}
    for k, (label, dim, x) in enumerate(pivots):
        by.setdefault((label, dim), ([], []))[0].append(k)
        by[label, dim][1].append(x)
    by = {k: (np.array(a), np.array(b)) for k, (a, b) in by.items()}

    def assign(batches):
        for batch in batches:
            label, dim = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            home, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for key in set(zip(label.tolist(), dim.tolist(), strict=True)):
                at = np.flatnonzero((label == key[0]) & (dim == key[1]))
                x = np.array([np.frombuffer(batch.column(2)[i].as_py()) for i in at.tolist()])
                ks, ps = by[key]
                dot = x @ ps.T
                best = dot.argmax(1)
                home[at], far[at] = ks[best], np.sqrt(np.maximum(0.0, 2 - 2 * dot.max(1)))
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(home), pa.array(far), batch.column(2), batch.column(4)], names=["id", "home", "far", "x", "w"])

    dealt = scratch.keep(single.select("label", "dim", "x", "id", "w").mapInArrow(assign, "id long, home long, far double, x binary, w long"))
    stats = {r.home: (r.far, max(1, -(-r.m // cell))) for r in dealt.groupBy("home").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("m")).collect()}
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9
    partners: dict[int, list[int]] = {k: [] for k in stats}
    for (_, _), (ks, ps) in by.items():
        d = np.sqrt(np.maximum(0.0, 2 - 2 * ps @ ps.T))
        for i, a in enumerate(ks.tolist()):
            for j, b in enumerate(ks.tolist()):
                if a in stats and b in stats and d[i, j] <= stats[a][0] + stats[b][0] + reach:
                    partners[a].append(b)

    def spread(batches):
        """A row for each task its sub-cell takes part in; a task is a pair of sub-cells."""
        for batch in batches:
            homes = batch.column(1).to_numpy()
            mixed = (batch.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for home in np.unique(homes).tolist():
                at = np.flatnonzero(homes == home)
                sub = (mixed[at].astype(np.int64) % stats[home][1])[:, None]
                other = np.concatenate([np.full(stats[o][1], o) for o in partners[home]])
                part = np.concatenate([np.arange(stats[o][1]) for o in partners[home]])
                step = max(1, 65536 // len(other))
                for k in range(0, len(at), step):
                    me = sub[k : k + step]
                    ahead = (home < other) | ((home == other) & (me <= part))
                    ends = (np.where(ahead, home, other), np.where(ahead, me, part), np.where(ahead, other, home), np.where(ahead, part, me))
                    take = pa.array(np.repeat(at[k : k + step], len(other)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.ravel()) for c in ends), pa.array(~ahead.ravel()), *(batch.column(c).take(take) for c in (0, 3, 4))], names=["a", "sa", "b", "sb", "second", "id", "x", "w"])

    keys = ["a", "sa", "b", "sb"]
    tasks = dealt.mapInArrow(spread, "a long, sa long, b long, sb long, second boolean, id long, x binary, w long").repartition(n_parts, *keys).sortWithinPartitions(*keys, "id")

    def compare(batches):
        held: list[tuple] = []
        last = None

        def flush():
            sides = [[h for h in held if h[0] == s] for s in (False, True)]
            ids = [np.array([h[1] for h in s], np.int64) for s in sides]
            xs = [np.array([np.frombuffer(h[2]) for h in s]) for s in sides]
            ws = [np.array([h[3] for h in s], np.int64) for s in sides]
            links = [np.zeros(len(s), np.int64) for s in sides]
            inner = last[:2] == last[2:]
            total = len(sides[0]) + len(sides[1])
            up = np.arange(total)
            span: list[tuple[int, int]] = []

            def find(v):
                while up[v] != v:
                    up[v] = up[up[v]]
                    v = up[v]
                return v

            other, shift = (0, 0) if inner else (1, len(sides[0]))

            def unite(p, qs):
                """Link p with the rows qs, one row of each component."""
                roots = up[qs]
                while (roots != up[roots]).any():
                    roots = up[roots]
                up[qs] = roots
                for k in np.unique(roots, return_index=True)[1].tolist():
                    x, y = find(p), find(qs[k])
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        span.append((p, int(qs[k])))

            def emit(i, j):
                np.add.at(links[0], i, ws[other][j])
                np.add.at(links[other], j, ws[0][i])
                cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1], [True])))
                for s, t in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    unite(int(i[s]), j[s:t] + shift)

            def emit_all(i, j):
                if j is None:
                    links[0][i] += ws[0][i].sum() - ws[0][i]
                    unite(int(i[0]), i[1:])
                    return
                links[0][i] += ws[other][j].sum()
                links[other][j] += ws[0][i].sum()
                unite(int(i[0]), j + shift)
                unite(int(j[0]) + shift, i)

            if inner and len(sides[0]) > 1:
                dual(CoverTree(xs[0], reach), None, cosine, emit, emit_all)
            elif not inner and len(sides[0]) and len(sides[1]):
                dual(CoverTree(xs[0], reach), CoverTree(xs[1], reach), cosine, emit, emit_all)
            every, count = np.concatenate(ids), np.concatenate(links)
            hit = np.flatnonzero(count)
            a = [*every[hit].tolist(), *(int(every[p]) for p, _ in span)]
            b = [*([None] * len(hit)), *(int(every[q]) for _, q in span)]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*count[hit].tolist(), *([0] * len(span))], pa.int64())], names=["a", "b", "n"])

        for batch in batches:
            for *key, second, i, x, w in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if key != last:
                    if held:
                        yield flush()
                    held, last = [], key
                held.append((second, i, x, w))
        if held:
            yield flush()

    found = scratch.keep(tasks.mapInArrow(compare, "a long, b long, n long"))
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = components(found.filter("b is not null").select("a", "b"), scratch).select(F.col("node").alias("rep"), "component")
    own = copies.join(counts, "rep", "left").join(parts, "rep", "left").select("id", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = rows.select("vec_id", "id").join(own, "id", "left").withColumn("component", F.coalesce("component", "id"))
    if keyed is None:
        out = out.withColumn("component_id", F.col("component"))
    else:
        out = out.join(rows.select(F.col("id").alias("component"), F.col("vec_id").alias("component_id")).distinct(), "component")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", (F.col("id") == F.col("component")).alias("kept"))
