"""Analyses of package structure over package_deps(src_pkg, tgt_pkg, src_class, tgt_class)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import names as N

#: What a target's kind says about a dependency.
CONTRACT, MODEL = ("INTERFACE", "ABSTRACT"), ("DATA_CLASS", "RECORD", "ANNOTATED_MODEL")


def package_deps(edges: DataFrame) -> DataFrame:
    """Call edges -> distinct dependencies between different, non-empty packages."""
    out = edges.select(N.package_name(F.col("caller_class")).alias("src_pkg"), N.package_name(F.col("callee_class")).alias("tgt_pkg"), F.col("caller_class").alias("src_class"), F.col("callee_class").alias("tgt_class"))
    return out.filter("src_pkg <> '' and tgt_pkg <> '' and src_pkg <> tgt_pkg").distinct()


def about_package(deps: DataFrame, prefix: str) -> DataFrame:
    """Dependencies either end of which starts with the prefix (any string, an empty one keeps all)."""
    return deps.filter(F.col("src_pkg").startswith(prefix) | F.col("tgt_pkg").startswith(prefix)) if prefix else deps


def dependents(deps: DataFrame) -> DataFrame:
    """(package, used_by) of distinct package pairs: the dependencies read backwards."""
    return deps.select(F.col("tgt_pkg").alias("package"), F.col("src_pkg").alias("used_by")).distinct()


def find_packages(deps: DataFrame, pattern: str) -> DataFrame:
    """(package) at either end that matches a case-insensitive regex."""
    both = deps.select(F.col("src_pkg").alias("package")).union(deps.select("tgt_pkg")).distinct()
    return both.filter(F.col("package").rlike("(?i)" + pattern))


def cycle_edges(loops: DataFrame, deps: DataFrame, depth: int = 2, root: str = "") -> DataFrame:
    """(component, src, tgt, src_class, tgt_class) of dependencies inside a cycle; loops: (component, node) of truncated packages."""
    t = deps.select(N.truncate_package(F.col("src_pkg"), depth, root).alias("src"), N.truncate_package(F.col("tgt_pkg"), depth, root).alias("tgt"), "src_class", "tgt_class").filter("src <> tgt").distinct()
    a, b = loops.select("component", F.col("node").alias("src")), loops.select("component", F.col("node").alias("tgt"))
    return t.join(a, "src").join(b, ["component", "tgt"]).select("component", "src", "tgt", "src_class", "tgt_class")


def dsm(deps: DataFrame, depth: int = 2, root: str = "") -> DataFrame:
    """Cells of the matrix: distinct class pairs between truncated packages."""
    t = deps.select(N.truncate_package(F.col("src_pkg"), depth, root).alias("src"), N.truncate_package(F.col("tgt_pkg"), depth, root).alias("tgt"))
    return t.filter("src <> tgt").groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("refs"))


def two_cycles(cells: DataFrame) -> DataFrame:
    back = cells.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), F.col("refs").alias("back_refs"))
    return cells.join(back, ["src", "tgt"]).filter("src < tgt").select("src", "tgt", "refs", "back_refs")


def distance(a: Column, b: Column) -> Column:
    """Segments of both that are not in the common prefix; an empty name has none."""
    seg = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\."))
    x, y = seg(a), seg(b)
    pairs = F.arrays_zip(x.alias("p"), y.alias("q"))
    first = F.array_position(F.transform(pairs, lambda s: ~s.getField("p").eqNullSafe(s.getField("q"))), F.lit(True))
    common = F.when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first - 1)
    return (F.size(x) + F.size(y) - 2 * common).cast("long")


def distances(cells: DataFrame, n: int | None = None) -> DataFrame:
    from sparkloom.operators.history import top

    return top(cells.select("src", "tgt", distance(F.col("src"), F.col("tgt")).alias("distance"), F.col("refs").alias("dependencies")), n, F.desc("distance"), "src", "tgt")


def root_package(packages: DataFrame, c: str = "package") -> DataFrame:
    """Leading segments that all non-empty packages share: those of the least and the greatest."""
    m = packages.filter(F.col(c) != "").agg(F.min(F.split(c, r"\.")).alias("x"), F.max(F.split(c, r"\.")).alias("y"))
    same = F.transform(F.arrays_zip("x", "y"), lambda s: ~s["x"].eqNullSafe(s["y"]))
    at = F.array_position(same, F.lit(True))
    return m.select(F.array_join(F.when(at == 0, F.col("x")).otherwise(F.slice("x", F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))), ".").alias("root"))


def strength(deps: DataFrame, kinds: DataFrame, n: int | None = None) -> DataFrame:
    """Strongest knowledge that crosses each package pair: contract 1, model 2, functional 3; all unknown counts as 1."""
    from sparkloom.operators.history import top

    d = deps.join(kinds.select(F.col("class").alias("tgt_class"), "kind"), "tgt_class", "left")
    out = d.groupBy(F.col("src_pkg").alias("src"), F.col("tgt_pkg").alias("tgt")).agg(
        F.count_if(F.col("kind").isin(*CONTRACT)).alias("contract"), F.count_if(F.col("kind").isin(*MODEL)).alias("model"), F.count_if(F.col("kind") == "CONCRETE").alias("functional"), F.count_if(F.col("kind").isNull()).alias("unknown"), F.count(F.lit(1)).alias("total")
    )
    out = out.withColumn("level", F.when(F.col("functional") > 0, 3).when(F.col("model") > 0, 2).otherwise(1).cast("long"))
    return top(out, n, F.desc("level"), F.desc("total"), "src", "tgt")


def balance(strong: DataFrame, volatile: DataFrame) -> DataFrame:
    """Verdict on each dependency from strength, distance and volatility (lower median as the bar)."""
    v = volatile.select("package", "revisions")
    bar = v.agg(F.percentile_disc(0.5, "revisions").alias("median")) if hasattr(F, "percentile_disc") else v.agg(F.expr("percentile_disc(0.5) within group (order by revisions)").alias("median"))
    x = strong.select("src", "tgt", "level", "total", distance(F.col("src"), F.col("tgt")).alias("distance"))
    x = x.join(v.select(F.col("package").alias("src"), F.col("revisions").alias("src_revs")), "src", "left").join(v.select(F.col("package").alias("tgt"), F.col("revisions").alias("tgt_revs")), "tgt", "left")
    x = x.fillna(0, ["src_revs", "tgt_revs"]).crossJoin(F.broadcast(bar))  # one row
    strong_, far = F.col("level") >= 3, F.col("distance") >= 3
    moving = F.coalesce((F.greatest("src_revs", "tgt_revs") >= F.col("median")) & (F.col("median") > 0), F.lit(False))
    verdict = F.when(strong_ != far, "BALANCED").when(~strong_ & ~far, "OVER_ENGINEERED").when(moving, "DANGER").otherwise("TOLERABLE")
    return x.select("src", "tgt", "level", "distance", "src_revs", "tgt_revs", verdict.alias("verdict"))


def glob(pattern: str) -> str:
    """A regex of a layer's pattern: a star stands for anything at either end only."""
    if pattern == "*":
        return ""
    head, tail = pattern.startswith("*"), pattern.endswith("*")
    return ("" if head else "^") + re.escape(pattern[head : len(pattern) - tail]) + ("" if tail else "$")


def parse_layers(text: str) -> list[dict]:
    """Layers of a JSON config: name, patterns, peer_limit (0 unless given) and test_infrastructure of each; raises where one is unfit."""
    root = json.loads(text)
    if not isinstance(root, dict) or not isinstance(root.get("layers"), list):
        raise ValueError("a config needs an array of layers")
    out = []
    for x in root["layers"]:
        if not isinstance(x, dict) or not isinstance(x.get("name"), str):
            raise ValueError("a layer needs a name")
        if not isinstance(x.get("patterns"), list) or not all(isinstance(p, str) for p in x["patterns"]):
            raise ValueError(f"layer {x['name']!r} needs an array of patterns")
        limit, tests = x.get("peerLimit"), x.get("testInfrastructure")
        if limit is not None and (isinstance(limit, bool) or not isinstance(limit, (int, float, str))):
            raise ValueError(f"the peer limit of layer {x['name']!r} is no number")
        if tests is not None and not isinstance(tests, bool):
            raise ValueError(f"testInfrastructure of layer {x['name']!r} is neither true nor false")
        out.append({"name": x["name"], "patterns": x["patterns"], "peer_limit": int(limit or 0), "test_infrastructure": bool(tests)})
    return out


def layer_of(name: Column, layers: list[dict]) -> Column:
    """Index of the first layer with a pattern that matches; of names that end in Kt or Test, what is left without is tried first."""

    def first(c):
        out = F
        for i, layer in enumerate(layers):
            if layer["patterns"]:
                out = out.when(c.rlike("|".join(f"(?:{glob(p)})" for p in layer["patterns"])), F.lit(i))
        return out.otherwise(F.lit(None).cast("int")) if out is not F else F.lit(None).cast("int")

    tried = F.filter(F.transform(N.candidate_names(name), first), lambda i: i.isNotNull())
    return F.coalesce(F.get(tried, F.lit(0)), first(name))


def layered(deps: DataFrame, layers: list[dict]) -> DataFrame:
    """(class, layer) of every class at either end; the layer's index is null where none matches."""
    both = deps.select(F.col("src_class").alias("class")).union(deps.select("tgt_class")).distinct()
    return both.withColumn("layer", layer_of(N.simple_name(F.col("class")), layers))


def unassigned(deps: DataFrame, layers: list[dict]) -> DataFrame:
    """(class) of dependencies' ends that no layer matches."""
    return layered(deps, layers).filter("layer is null").select("class")


def layer_check(deps: DataFrame, layers: list[dict]) -> DataFrame:
    """Violations: OUTWARD dependencies, and PEER ones beyond a layer's limit (0 unless given; below 0: none). Layers go from outer to inner."""
    at = layered(deps, layers).filter("layer is not null")
    c = deps.select("src_class", "tgt_class").distinct().join(at.select(F.col("class").alias("src_class"), F.col("layer").alias("s")), "src_class").join(at.select(F.col("class").alias("tgt_class"), F.col("layer").alias("t")), "tgt_class")
    name = F.array(*(F.lit(x["name"]) for x in layers))
    limit = F.array(*(F.lit(int(x.get("peer_limit", 0))) for x in layers))
    infra = F.array(*(F.lit(bool(x.get("test_infrastructure", False))) for x in layers))
    peers = c.filter("s = t").groupBy("src_class").agg(F.count(F.lit(1)).alias("peers"))
    free = F.get(infra, F.col("t")) & N.is_test(F.col("src_class"))
    kind = F.when((F.col("t") < F.col("s")) & ~free, "OUTWARD").when((F.col("s") == F.col("t")) & (F.get(limit, F.col("s")) >= 0) & (F.col("peers") > F.get(limit, F.col("s"))), "PEER")
    found = c.join(peers, "src_class", "left").withColumn("type", kind).filter("type is not null")
    return found.select("type", "src_class", "tgt_class", F.get(name, F.col("s")).alias("src_layer"), F.get(name, F.col("t")).alias("tgt_layer"))
