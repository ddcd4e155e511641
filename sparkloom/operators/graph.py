"""Graph kernels: strongly connected components, PageRank, degrees, liveness."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from sparkloom.functions import names as N
from sparkloom.operators.components import components
from sparkloom.util import Scratch


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], scratch: Scratch, most: int = 10_000) -> DataFrame:
    """All rows reached from start by step, each round from the new rows only.

    Only new rows are written; the parts of 32 rounds become one table, so plans stay short.
    """
    keys = start.columns
    known = frontier = scratch.keep(start.distinct())
    for i in range(1, most):
        frontier = scratch.keep(step(frontier).select(keys).distinct().join(known, keys, "left_anti"))
        if frontier.isEmpty():
            return known
        known = known.union(frontier)
        if i % 32 == 0:
            known = scratch.keep(known)
    raise RuntimeError("fixpoint did not end")


def _folded(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame], DataFrame | None]:
    """Edges with every node that has one edge into it folded into the node that edge comes from, and so on up to a root.

    Gives (edges left, pointers by doubled steps, rings). A node with one edge into it lies on no cycle without the edge's
    start, so what the roots' cycles are tells the rest (`_unfolded`). Pointers double, so a chain of n nodes takes log n rounds. What
    hangs below a root that nothing leads to goes. Where pointers end nowhere they run round a ring, which is a component.
    """
    into = scratch.keep(e.groupBy("tgt").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("to")))
    at = scratch.keep(into.filter("n = 1").select(F.col("tgt").alias("node"), "to", F.col("tgt").alias("low"), F.lit(True).alias("moved")))
    steps, n, length = [at], at.count(), 1
    while length <= n:
        up = at.select(F.col("node").alias("to"), F.col("to").alias("up"), F.col("low").alias("below"))
        moved = F.col("up").isNotNull()
        at = scratch.keep(at.join(up, "to", "left").select("node", F.coalesce("up", "to").alias("to"), F.least("low", "below").alias("low"), moved.alias("moved")))
        length *= 2
        if at.filter("moved").isEmpty():
            break
        steps.append(at)
    many = into.filter("n > 1").select("tgt")
    # after more steps than there are nodes, who still points at a node with a pointer hangs on a ring, and those pointed at are the ring
    lost = at.join(at.select(F.col("node").alias("to")), "to", "left_semi") if length > n else at.filter("false")
    ring = at.join(lost.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(F.col("low").alias("component"), "node")
    roots = at.join(lost, "node", "left_anti").select(F.col("node").alias("src"), F.col("to").alias("root"))
    kept = e.join(many, "tgt", "left_semi").join(lost.select(F.col("node").alias("src")), "src", "left_anti").join(roots, "src", "left").select(F.coalesce("root", "src").alias("src"), "tgt")
    kept = kept.filter("src <> tgt").join(many.withColumnRenamed("tgt", "src"), "src", "left_semi").distinct()
    return scratch.keep(kept), steps, scratch.keep(ring)


def _unfolded(found: DataFrame, e: DataFrame, steps: list[DataFrame], ring: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, node) of the edges e from those of the edges that `_folded` left of them.

    A folded node belongs to its root's component if it, or one folded below it, has an edge to a node of that component.
    """
    at = steps[-1]
    many = e.groupBy("tgt").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("tgt")
    name = lambda c, to: found.select(F.col("node").alias(c), F.col("component").alias(to))
    back = e.join(many, "tgt", "left_semi").join(at.select(F.col("node").alias("src"), F.col("to").alias("root")), "src")
    back = back.join(name("root", "a"), "root", "left").join(name("tgt", "b"), "tgt", "left")
    marked = scratch.keep(back.filter(F.coalesce("a", "root") == F.coalesce("b", "tgt")).select(F.coalesce("a", "root").alias("component"), F.col("src").alias("node")).distinct())
    if not marked.isEmpty():
        for step in steps:
            marked = scratch.keep(marked.union(marked.join(step, "node").select("component", F.col("to").alias("node"))).distinct())
    return scratch.keep(found.union(marked).distinct().union(ring))


def _least_above(e: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, color, moved): the least node from which a path leads to the node, itself included."""
    color = scratch.keep(e.select(F.col("src").alias("node")).union(e.select("tgt")).distinct().select("node", F.col("node").alias("color"), F.lit(True).alias("moved")))
    while not color.filter("moved").isEmpty():
        said = color.filter("moved").select(F.col("node").alias("src"), "color").join(e, "src").groupBy(F.col("tgt").alias("node")).agg(F.min("color").alias("said"))
        lower = F.coalesce(F.col("said") < F.col("color"), F.lit(False))
        new = scratch.keep(color.join(said, "node", "left").select("node", F.when(lower, F.col("said")).otherwise(F.col("color")).alias("color"), lower.alias("moved")))
        scratch.drop(color)
        color = new
    return color.drop("moved")


def _coloured(e: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(component, node) of one round of colours, and the edges inside colours that it leaves."""
    color = _least_above(e, scratch)
    a, b = color.select(F.col("node").alias("src"), "color"), color.select(F.col("node").alias("tgt"), F.col("color").alias("other"))
    inner = scratch.keep(e.join(a, "src").join(b, "tgt").filter("color = other").select("src", "tgt", "color"))
    back = inner.select(F.col("tgt").alias("node"), "color", F.col("src").alias("next"))
    own = fixpoint(color.filter("node = color"), lambda now: now.join(back, ["node", "color"]).select(F.col("next").alias("node"), "color"), scratch)
    large = own.groupBy("color").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("color")
    found = scratch.keep(own.join(large, "color").select(F.col("color").alias("component"), "node"))
    gone = lambda c: own.select(F.col("node").alias(c))
    return found, scratch.keep(inner.select("src", "tgt").join(gone("src"), "src", "left_anti").join(gone("tgt"), "tgt", "left_anti"))


def cycles(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(component, node) of strongly connected components with two nodes or more, named by their least node.

    Nodes with one edge into them, then those with one edge out, are folded away by doubled steps until none is left:
    chains, trees and rings of any length take a logarithm of it in rounds. The rest is coloured: each node takes the least
    node that reaches it, and a colour's component is what reaches its least node without leaving the colour. What is
    found, and edges between colours, go; the rest starts again. Tables grow with nodes and edges only.
    """
    e = scratch.keep(edges.select("src", "tgt").filter("src <> tgt").distinct())
    none = e.select(F.col("src").alias("component"), F.col("src").alias("node")).limit(0)
    turned = lambda df: df.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"))
    done: list[tuple] = []  # what undoes each step, last first
    n = e.count()
    while n:
        before = n
        for _ in range(2):  # by edges into nodes, then by edges out of them
            left, steps, ring = _folded(e, scratch)
            done.append((e, steps, ring))
            e, n = turned(left), left.count()
            if not n:
                break
        if n > 0.9 * before:  # folding has little left to do
            found, e = _coloured(e, scratch)
            done.append((found,))
            n = e.count()
    out = none
    for step in reversed(done):
        out = out.union(step[0]) if len(step) == 1 else _unfolded(out, *step, scratch)
    least = out.groupBy("component").agg(F.min("node").alias("least"))
    return out.join(least, "component").select(F.col("least").alias("component"), "node")


def pagerank(edges: DataFrame, scratch: Scratch, rounds: int = 20, damping: float = 0.85, fed_only: bool = False) -> DataFrame:
    """(node, rank) after synchronous rounds; dangling rank is not handed on. Lineage is cut every five rounds.

    Every node keeps its share of (1 - damping) / n. fed_only: a round has only nodes with an edge from a node of the round
    before, so one that nothing leads to is gone after the first, and what it would hand on with it; n stays.
    """
    e = scratch.keep(edges.select("src", "tgt").filter("src <> tgt").distinct())
    nodes = scratch.keep(e.select(F.col("src").alias("node")).union(e.select("tgt")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    e = scratch.keep(e.join(out, "src"))
    rank = nodes.withColumn("rank", F.lit(1.0 / n))
    for i in range(rounds):
        given = e.join(rank.withColumnRenamed("node", "src"), "src").groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        rank = (given if fed_only else nodes.join(given, "node", "left")).select("node", (F.lit((1 - damping) / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 5 == 4:
            rank = scratch.keep(rank)
    return rank


def collapsed(edges: DataFrame) -> DataFrame:
    """Call edges with lambda classes counted as the classes they stand in."""
    return edges.withColumn("caller_class", N.collapse_lambda(F.col("caller_class"))).withColumn("callee_class", N.collapse_lambda(F.col("callee_class")))


def complexity_by_class(edges: DataFrame, pattern: str = "", collapse: bool = False) -> DataFrame:
    """(class, side, other, calls): method-level calls between a class without `$` that matches (case counts) and each other class."""
    cross = edges.filter("caller_class <> callee_class").distinct()
    ends = lambda own, other, side: cross.select(F.col(f"{own}_class").alias("class"), F.lit(side).alias("side"), F.col(f"{other}_class").alias("other"))
    rows = ends("caller", "callee", "out").union(ends("callee", "caller", "in")).filter(F.col("class").rlike(pattern) & ~F.col("class").contains("$"))
    if collapse:
        rows = rows.withColumn("other", N.collapse_lambda(F.col("other")))
    return rows.groupBy("class", "side", "other").agg(F.count(F.lit(1)).alias("calls"))


def complexity(edges: DataFrame) -> DataFrame:
    """Per class: method-level calls out of and into it, and the distinct classes at the other end."""
    cross = edges.filter("caller_class <> callee_class").distinct()
    out = cross.groupBy(F.col("caller_class").alias("class")).agg(F.count(F.lit(1)).alias("fan_out"), F.countDistinct("callee_class").alias("classes_out"))
    into = cross.groupBy(F.col("callee_class").alias("class")).agg(F.count(F.lit(1)).alias("fan_in"), F.countDistinct("caller_class").alias("classes_in"))
    return out.join(into, "class", "full").fillna(0).select("class", "fan_out", "classes_out", "fan_in", "classes_in")


def live(roots: DataFrame, edges: DataFrame, scratch: Scratch, most: int = 10_000) -> DataFrame:
    """(node) reachable from roots along (src, tgt), roots included."""
    out = scratch.keep(edges.select(F.col("src").alias("node"), "tgt").distinct())
    return fixpoint(roots.select("node"), lambda now: now.join(out, "node").select(F.col("tgt").alias("node")), scratch, most)


__all__ = ["complexity", "components", "cycles", "fixpoint", "live", "pagerank"]
