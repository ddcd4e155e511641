"""N-gram Jaccard join by signature trees (operator 9).

A document's set: 64-bit hashes of its distinct k-word shingles (all its words as one where it has fewer).
Sets are interned by a hash of the set, so exact copies cost nothing further.

Candidates, without loss: two linked sets differ in at most D shingles. Shingles are dealt by hash to
m > D parts, so at least one part of two linked sets is equal. Each set emits a key for each of its
parts; keys that one set alone holds are dropped. Sizes fall into classes, m is fixed by the class
of the larger set, and a set whose partners may lie in the next class emits keys there too. An empty
part gives no key: m has room for `slack` empty parts, and only sets with more of them emit keys for
their empty parts as well, which keeps the guarantee.

Parts of common passages make keys that many unlike sets hold. So m also has room for `spare` keys:
linked sets share more than `spare` of them, and each set drops its `spare` commonest keys of a
class, in one order of all keys (rows that hold it, then the key). The least common key that two
linked sets share has `spare` commoner ones in both, so both keep it. A set with no more than `spare`
shared keys drops out.

The least set that kept a key is its pivot. All sets of a key belong to the pivot's group, so every
linked pair meets in a group. Within a group a signature tree is joined with itself: nodes hold the
OR and the AND of token bitmaps and the range of sizes; node pairs that cannot reach the needed
overlap, or that are one component already, are pruned; leaves are verified on the whole sets of hashes.
Groups above `block` sets or `block_tokens` shingles are split into blocks by hash, each joined with itself and the pivot; sets
that stay apart from the pivot are then compared with every block of their group.

Results: one row per row of docs; documents without a word are linked with nothing; ids may be null
(never linked to by id: they count as the smallest id and come back as null).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.llm import kernels as K
from sparkloom.operators.components import components
from sparkloom.util import Scratch

LEAST = -(2**63)


@dataclass(frozen=True)
class Join:
    words: int = 3
    num: int = 90
    den: int = 100
    ratio: float = 1.5
    block: int = 1024  # sets of a block, and their shingles
    block_tokens: int = 2_000_000
    spare: float = 0.5

    def bounds(self) -> list[tuple[int, int, int, int, int]]:
        """(least size, greatest size, parts, slack, spare keys) by class, sizes ascending."""
        out, lo = [], 1
        while lo < 2**40:
            hi = max(lo, int(lo * self.ratio))
            d = 2 * hi * (self.den - self.num) // (self.den + self.num)
            if d == 0:  # equal sets only: interned already
                out.append((lo, hi, 0, 0, 0))
            else:
                slack, spare = 2 + d // 24, int(np.ceil(d * self.spare))
                out.append((lo, hi, d + 1 + slack + spare, slack, spare))
            lo = hi + 1
        return out

    def linked(self, both, either):
        return self.den * both >= self.num * either


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    hashes, _, _, at = K.words(K.lower(data), offsets)
    out = []
    n = len(hashes)
    p = K.prefix(hashes)
    grams = K.slices(p, np.arange(max(0, n - k + 1)), np.arange(max(0, n - k + 1)) + k) if n >= k else np.zeros(0, np.uint64)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(K.slices(p, np.array([a]), np.array([b])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_id(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        x = K.mix(s + np.uint64(0x51ED270B)).sum(dtype=np.uint64) * np.uint64(31) + np.uint64(len(s))
    return int(K.mix(np.array([x], np.uint64)).view(np.int64)[0])


#: The low bits of a key hold its class.
CLASS_BITS = 7


def keys_of(s: np.ndarray, bounds: list, starts: np.ndarray, join: Join) -> np.ndarray:
    """Keys of a sorted set in its class and, if partners may be there, the next."""
    n = len(s)
    own = int(np.searchsorted(starts, n, "right")) - 1
    out = []
    for c in (own, own + 1):
        if c > own and n * join.den // join.num < bounds[c][0]:
            break
        _, _, m, slack, _ = bounds[c]
        if not m:
            continue
        part = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)  # ascends with s
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(K.mix(s), cut)
            keys = K.mix(sums * np.uint64(3) + part[cut] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c * 1_000_003 + 7))
            if m - len(cut) > slack:
                empty = np.setdiff1d(np.arange(m, dtype=np.uint64), part[cut])
                keys = np.concatenate((keys, K.mix(empty * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(c * 7_000_003 + 13))))
        out.append((keys & ~np.uint64((1 << CLASS_BITS) - 1)) | np.uint64(c))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_blocks(batches, join: Join):
    """(rows, sets) of bounded blocks of rows; the text is the second column."""
    for batch in batches:
        data, offsets = K.buffers(batch.column(1))
        for i, j in K.blocks(offsets, 1 << 20):
            yield batch.slice(i, j - i), shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], join.words)


def set_ids(join: Join):
    def run(batches):
        for rows, sets in set_blocks(batches, join):
            ids = pa.array([set_id(s) for s in sets], pa.int64(), mask=np.array([not len(s) for s in sets], bool))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([len(s) for s in sets], pa.int64()), ids], names=["doc_id", "body", "n", "set_id"])

    return run


def set_keys(join: Join, remember: int = 200_000):
    def run(batches):
        bounds = join.bounds()
        starts = np.array([b[0] for b in bounds])
        seen: set[int] = set()
        for _, sets in set_blocks(batches, join):
            ids, keys = [], []
            for s in sets:
                if not len(s) or (x := set_id(s)) in seen:  # a copy of a set that this task has seen emits no keys again
                    continue
                seen.add(x)
                ids.append(x)
                keys.append(keys_of(s, bounds, starts, join).view(np.int64))
            if len(seen) > remember:
                seen = set()
            if ids:
                at = np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(keys), pa.int64()))], names=["set_id", "keys"])

    return run


def sets_only(join: Join):
    def run(batches):
        for rows, sets in set_blocks(batches, join):
            meant = [(x, s.tobytes()) for x, s in zip(rows.column(0).to_pylist(), sets, strict=True) if len(s) and set_id(s) == x]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in meant], pa.int64()), pa.array([s for _, s in meant], pa.binary())], names=["set_id", "tokens"])

    return run


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Words of the product of two leaves' bitmaps.
PRODUCT = 1 << 18


class SignatureTree:
    """A static tree over sets: leaves of `leaf` sets in the order of size and bitmap, `fan` children to a node.

    Two leaves are compared by one product of their bitmaps; leaves of long bitmaps are smaller, so that it stays small.
    """

    def __init__(self, sets: list[np.ndarray], leaf: int = 64, fan: int = 4):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.words = max(1, 1 << int(np.ceil(np.log2(max(1, 2 * self.size.max(initial=1)) / 64))) if self.size.max(initial=1) > 32 else 1)
        self.words = min(self.words, 1024)  # fewer bits than tokens only weaken the bound
        self.bits = np.zeros((len(sets), self.words), np.uint64)
        for i, s in enumerate(sets):
            row = np.zeros(self.words * 64, bool)
            row[(s & np.uint64(self.words * 64 - 1)).astype(np.int64)] = True
            self.bits[i] = np.packbits(row).view(np.uint64)
        self.ones = np.bitwise_count(self.bits).sum(axis=1, dtype=np.int64)
        leaf = min(leaf, max(8, int((PRODUCT / self.words) ** 0.5)))
        order = np.lexsort((self.bits[:, 0], self.size))
        # nodes: (or, and, least size, greatest size, children or members)
        level = []
        for i in range(0, len(order), leaf):
            m = order[i : i + leaf]
            level.append(self._node(np.bitwise_or.reduce(self.bits[m]), np.bitwise_and.reduce(self.bits[m]), self.size[m].min(), self.size[m].max(), None, m.tolist()))
        while len(level) > 1:
            level = [
                self._node(np.bitwise_or.reduce([x["or"] for x in g]), np.bitwise_and.reduce([x["and"] for x in g]), min(x["lo"] for x in g), max(x["hi"] for x in g), g, sum((x["members"] for x in g), []))
                for g in (level[i : i + fan] for i in range(0, len(level), fan))
            ]
        self.root = level[0] if level else None

    @staticmethod
    def _node(any_, all_, lo, hi, children, members):
        return {"or": any_, "and": all_, "lo": int(lo), "hi": int(hi), "children": children, "members": members}


def _pairs(tree: SignatureTree, a: list[int], b: list[int], join: Join, forest: Forest, probes: set[int] | None) -> list[list[int]]:
    """The sets of two leaves, in pairs of different components, that may still be linked by their bitmaps and sizes."""
    i, j = np.array(a), np.array(b)
    n, m = tree.size[i][:, None], tree.size[j][None, :]
    both = np.bitwise_count(tree.bits[i][:, None, :] & tree.bits[j][None, :, :]).sum(axis=2, dtype=np.int64)
    # tokens whose bits the other set lacks are its own
    most = np.minimum(n - tree.ones[i][:, None] + both, m - tree.ones[j][None, :] + both)
    may = join.den * most >= join.num * (n + m - most)
    if a is b:
        may = np.triu(may, 1)
    if may.any():
        home = lambda x: np.array([forest.find(k) for k in x])
        may &= home(a)[:, None] != home(b)[None, :]
        if probes is not None:
            probe = lambda x: np.array([k in probes for k in x])
            may &= probe(a)[:, None] | probe(b)[None, :]
    x, y = np.nonzero(may)
    return np.stack((i[x], j[y]), axis=1).tolist()


def _reach(a, b, join: Join) -> bool:
    """Whether some pair below two nodes can still reach the threshold."""
    if join.den * min(a["hi"], b["hi"]) < join.num * max(a["lo"], b["lo"]):
        return False
    # tokens that all sets of one node have and no set of the other can have
    x = a["hi"] - int(np.bitwise_count(a["and"] & ~b["or"]).sum())
    y = b["hi"] - int(np.bitwise_count(b["and"] & ~a["or"]).sum())
    most = min(x, y)
    return join.den * most >= join.num * max(a["lo"], b["lo"])


def tree_join(sets: list[np.ndarray], join: Join, forest: Forest | None = None, probes: set[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of the sets (positions); with probes, pairs with a probe only."""
    forest = forest or Forest(len(sets))
    out: list[tuple[int, int]] = []
    if len(sets) < 2:
        return out
    tree = SignatureTree(sets)
    stack = [(tree.root, tree.root)]
    one = lambda members: len({forest.find(i) for i in members}) == 1
    while stack:
        a, b = stack.pop()
        if a is not b and not _reach(a, b, join):
            continue
        if probes is not None and probes.isdisjoint(a["members"]) and probes.isdisjoint(b["members"]):
            continue
        if forest.find(a["members"][0]) == forest.find(b["members"][0]) and one(a["members"]) and (a is b or one(b["members"])):
            continue
        if a["children"] or b["children"]:
            if a is b:
                c = a["children"]
                stack += [(c[i], c[j]) for i in range(len(c)) for j in range(i, len(c))]
            elif a["children"] and (not b["children"] or len(a["members"]) >= len(b["members"])):
                stack += [(x, b) for x in a["children"]]
            else:
                stack += [(a, x) for x in b["children"]]
            continue
        for i, j in _pairs(tree, a["members"], b["members"], join, forest, probes):
            if forest.find(i) != forest.find(j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if join.linked(both, len(sets[i]) + len(sets[j]) - both):
                    forest.join(i, j)
                    out.append((i, j))
    return out


def group_join(join: Join, probing: bool):
    """Sorted rows (pivot, block, set_id, tokens, probe) -> links and, first time, sets apart from the pivot (b null)."""

    def run(batches):
        held: list[tuple] = []
        last = None

        def flush():
            pivot = last[0]
            ids = [h[0] for h in held]
            sets = [np.frombuffer(h[1], np.uint64) for h in held]
            forest = Forest(len(ids))
            probes = {i for i, h in enumerate(held) if h[2]} if probing else None
            rows = [(pivot, ids[i], ids[j]) for i, j in tree_join(sets, join, forest, probes)]
            if not probing:
                home = forest.find(ids.index(pivot))
                rows += [(pivot, x, None) for i, x in enumerate(ids) if forest.find(i) != home]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["pivot", "a", "b"])

        for batch in batches:
            for p, b, x, t, probe in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (p, b) != last:
                    if held:
                        yield flush()
                    held, last = [], (p, b)
                held.append((x, t, probe))
        if held:
            yield flush()

    return run


def jaccard_components(docs: DataFrame, scratch: Scratch, join: Join = Join(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    body = F.xxhash64("text")
    all_ = scratch.keep(docs.select("doc_id", "text", body.alias("body")).mapInArrow(K.returning(set_ids(join)), "doc_id long, body long, n long, set_id long"))
    # a task lists keys of a set once, so a set's keys may come from several tasks: only distinct sets count.
    # Keys are dealt out once, for the counts and for the join with them; a key holds one row of a set's many.
    rows = docs.select("doc_id", "text").mapInArrow(K.returning(set_keys(join)), "set_id long, keys array<long>").select("set_id", F.explode("keys").alias("key")).repartition(n_parts, "key")
    held = lambda r: r.groupBy("key").agg(F.min("set_id").alias("pivot"), F.max("set_id").alias("other"), F.count(F.lit(1)).alias("held")).filter("pivot <> other").drop("other")
    kind = F.col("key").bitwiseAND((1 << CLASS_BITS) - 1).cast("int")
    order = Window.partitionBy("set_id", kind).orderBy(F.desc("held"), "key")
    spare = F.element_at(F.array(*(F.lit(b[4]) for b in join.bounds())), kind + 1)
    # one sort by key, in place of an aggregation and a join: nearly every key is its set's own
    of_key = Window.partitionBy("key")
    counted = rows.withColumn("held", F.count(F.lit(1)).over(of_key)).withColumn("pivot", F.min("set_id").over(of_key)).withColumn("other", F.max("set_id").over(of_key)).filter("pivot <> other").drop("pivot", "other")
    kept = counted.withColumn("at", F.dense_rank().over(order)).filter(F.col("at") > spare)
    kept = scratch.keep(kept.select("set_id", "key").distinct())
    near = scratch.keep(kept.join(held(kept).drop("held"), "key").select("pivot", "set_id").filter("set_id <> pivot").distinct())
    keyed = all_.filter("set_id is not null")
    id_ = F.coalesce("doc_id", F.lit(LEAST))
    first = scratch.keep(keyed.groupBy("set_id").agg(F.min(id_).alias("doc"), F.min_by("body", id_).alias("body"), F.max("n").alias("n")))
    # sets of a key are of like size, so the pivot's stands for all
    sizes = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("m")).join(first.select(F.col("set_id").alias("pivot"), "n"), "pivot")
    blocks = F.ceil(F.greatest(F.col("m") / join.block, F.col("m") * F.col("n") / join.block_tokens)).cast("int")
    member = near.join(sizes, "pivot").select("pivot", "set_id", F.pmod(F.xxhash64("set_id"), blocks).cast("int").alias("block"), blocks.alias("blocks"))
    heads = sizes.select("pivot", F.col("pivot").alias("set_id"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), blocks.alias("blocks"))
    members = scratch.keep(member.unionByName(heads))
    wanted = first.select("set_id", "doc", "body").join(members.select("set_id").distinct(), "set_id")
    # ids may repeat or be null: the text's hash says which row is meant, the set's own hash has the last word
    texts = docs.select(id_.alias("doc"), body.alias("body"), "text").join(wanted, ["doc", "body"]).select("set_id", "text")
    sets = texts.mapInArrow(K.returning(sets_only(join)), "set_id long, tokens binary")
    if not all_.groupBy("doc_id", "body").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").isEmpty():
        sets = sets.dropDuplicates(["set_id"])
    sets = scratch.keep(sets)
    with_sets = members.join(sets, "set_id").withColumn("probe", F.lit(False))
    links = "pivot long, a long, b long"
    tasks = with_sets.select("pivot", "block", "set_id", "tokens", "probe").repartition(n_parts, "pivot", "block").sortWithinPartitions("pivot", "block", "set_id")
    found = scratch.keep(tasks.mapInArrow(K.returning(group_join(join, False)), links))
    edges = found.filter("b is not null").select("a", "b")
    apart = found.filter("b is null").select("pivot", F.col("a").alias("set_id")).join(sizes.filter(blocks > 1), "pivot")
    probe = apart.join(sets, "set_id").select("pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "set_id", "tokens", F.lit(True).alias("probe"))
    targets = with_sets.filter("blocks > 1").join(probe.select("pivot", "block").distinct(), ["pivot", "block"], "left_semi").join(apart.select("pivot", "set_id"), ["pivot", "set_id"], "left_anti").select("pivot", "block", "set_id", "tokens", "probe")
    again = probe.unionByName(targets).repartition(n_parts, "pivot", "block").sortWithinPartitions("pivot", "block", "set_id").mapInArrow(K.returning(group_join(join, True)), links)
    edges = edges.union(again.filter("b is not null").select("a", "b"))
    parts = components(edges, scratch).withColumnRenamed("node", "set_id")
    named = first.select("set_id", "doc").join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("doc").alias("least"))
    labels = named.join(least, "component").select("set_id", "least")
    out = all_.select("doc_id", "n", "set_id").join(labels, "set_id", "left")
    doc = F.coalesce("least", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), "set_id", F.when(doc == LEAST, F.lit(None)).otherwise(doc).alias("component_id"))
