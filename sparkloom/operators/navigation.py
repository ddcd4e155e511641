"""Navigation queries over code facts: usages, implementors, call trees, impact of changes, dead code, metrics."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkloom.functions import names as N
from sparkloom.operators.graph import fixpoint
from sparkloom.operators.presets import is_modifier
from sparkloom.util import Scratch

CALL = ("caller_class", "caller_method", "callee_class", "callee_method")

#: Method names that compilers generate.
GENERATED = ("<init>", "<clinit>", "toString", "hashCode", "equals", "copy", "$values", "valueOf", "values", "main")
#: Patterns of generated names.
GENERATED_FORMS = (r"^access\$", r"^component\d+$", r"^copy\$", r"^copy-[A-Za-z0-9]+(\$default)?$", r"\$lambda\$", r"^(box|unbox|equals|hashCode|toString|constructor)-impl\d*$", r"\$default$", r"\$\$forInline$")


def generated_method(m: Column) -> Column:
    return m.isin(*GENERATED) | m.rlike("|".join(GENERATED_FORMS))


def usages(edges: DataFrame, owner: str | None = None, method: str | None = None, outside: str | None = None) -> DataFrame:
    """Calls of what matches: owner a case-insensitive regex, method exact, callers inside the package `outside` left out."""
    if owner is None:
        raise ValueError("usages needs an owner")
    out = edges.filter(F.col("callee_class").rlike("(?i)" + owner))
    if method is not None:
        out = out.filter(F.col("callee_method") == method)
    if outside is not None:
        out = out.filter(~(F.col("caller_class").startswith(outside + ".")))
    return out.select(*CALL).distinct()


def usages_by_file(found: DataFrame, files: DataFrame) -> DataFrame:
    """(file, sites) of usages; files: (class, file)."""
    return found.join(files.withColumnRenamed("class", "caller_class"), "caller_class").groupBy("file").agg(F.count(F.lit(1)).alias("sites"))


def implementors(supers: DataFrame, pattern: str) -> DataFrame:
    """(supertype, implementors) of supertypes that match; names sorted and comma-joined."""
    hit = supers.filter(F.col("supertype").rlike("(?i)" + pattern)).select("supertype", "implementor").distinct()
    return hit.groupBy("supertype").agg(F.array_join(F.array_sort(F.collect_list("implementor")), ",").alias("implementors"))


def changed_since(changed: DataFrame, sources: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((class, callers) of classes in changed files, files that are no class's).

    A file (path) belongs to a class (class, path) where it equals the class's path or ends with it
    after a slash: its suffixes are joined by equality. Several paths: the first in order counts.
    Callers are distinct other classes, top level, that are not changed files' own.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    tails = changed.select("path").distinct().select(F.col("path").alias("file"), F.explode(suffixes).alias("path"))
    hits = tails.join(sources, "path")
    first = hits.groupBy("file").agg(F.min("path").alias("path"))
    classes = hits.join(first, ["file", "path"]).select("class").distinct()
    calls = edges.select(F.col("callee_class").alias("class"), F.col("caller_class").alias("caller")).filter("class <> caller").distinct()
    impact = classes.join(calls, "class", "left").groupBy("class").agg(F.count("caller").alias("callers"))
    lost = changed.select("path").distinct().join(first.select(F.col("file").alias("path")), "path", "left_anti")
    return impact, lost


def dead_code(
    edges: DataFrame,
    project: DataFrame,
    declared: DataFrame,
    supers: DataFrame,
    scratch: Scratch,
    tested: DataFrame | None = None,
    annotated: DataFrame | None = None,
    external: DataFrame | None = None,
    fields: DataFrame | None = None,
) -> DataFrame:
    """(kind, class, method, reason, confidence) of classes and methods that nothing live calls.

    project (class); declared (class, method); supers (supertype, implementor); tested (class, method)
    called by tests; annotated (class, method null for the class) and, if it has that column, annotation:
    a modifier on the class lowers its methods' confidence too; external (class) with supertypes outside
    the project lowers that of methods; fields (class, field), whose accessors are never dead. A call from
    another class makes the callee and its outer project classes live. Called methods reach implementors'
    methods of the same name, which makes the implementor live, and methods of their own class. An
    interface with a live implementor is live (one pass).
    """
    project = scratch.keep(project.select("class").distinct())
    inside = scratch.keep(edges.join(project.withColumnRenamed("class", "callee_class"), "callee_class", "left_semi"))
    called = inside.filter("caller_class <> callee_class").select(F.col("callee_class").alias("class"), F.col("callee_method").alias("method")).distinct()
    intra = scratch.keep(inside.filter("caller_class = callee_class").select(F.col("caller_class").alias("class"), F.col("caller_method").alias("method"), F.col("callee_method").alias("next")).distinct())
    impl = scratch.keep(supers.join(project.withColumnRenamed("class", "implementor"), "implementor", "left_semi").select(F.col("supertype").alias("class"), "implementor").distinct())

    def step(now: DataFrame) -> DataFrame:
        own = now.join(intra, ["class", "method"]).select("class", F.col("next").alias("method"), "via")
        return now.join(impl, "class").select(F.col("implementor").alias("class"), "method", F.lit(True).alias("via")).union(own)

    reached = fixpoint(called.withColumn("via", F.lit(False)), step, scratch)
    touched = called.select("class").union(reached.filter("via").select("class")).distinct()
    outers = fixpoint(touched, lambda now: now.select(N.outer_class(F.col("class")).alias("class")).filter("class is not null").join(project, "class", "left_semi"), scratch)
    above = impl.join(outers.withColumnRenamed("class", "implementor"), "implementor", "left_semi").select("class").join(project, "class", "left_semi")
    alive = scratch.keep(outers.union(above).distinct())
    classes = project.join(alive, "class", "left_anti").filter("not contains(class, '$') and not class like '%.package-info'").select(F.lit("CLASS").alias("kind"), "class", F.lit(None).cast("string").alias("method"))
    methods = declared.select("class", "method").distinct().join(project, "class", "left_semi").join(alive, "class", "left_semi").join(reached.select("class", "method").distinct(), ["class", "method"], "left_anti")
    methods = methods.filter(~F.col("class").contains("$") & ~F.col("method").contains("$") & ~generated_method(F.col("method"))).select(F.lit("METHOD").alias("kind"), "class", "method")
    if fields is not None:
        title = F.concat(F.upper(F.substring("field", 1, 1)), F.expr("substring(field, 2)"))
        accessors = fields.select("class", F.explode(F.array(*(F.concat(F.lit(p), title) for p in ("get", "set", "is")))).alias("method")).filter("method rlike '^(get|set|is)[A-Z]'").distinct()
        methods = methods.join(accessors, ["class", "method"], "left_anti")
    out = classes.unionByName(methods)
    none = out.select("kind", "class", "method").limit(0)
    by_test = none if tested is None else tested.select(F.lit("METHOD").alias("kind"), "class", "method").union(tested.select(F.lit("CLASS"), "class", F.lit(None).cast("string")))
    by_note = none if annotated is None else annotated.select(F.when(F.col("method").isNull(), "CLASS").otherwise("METHOD").alias("kind"), "class", "method")
    for df, name in ((by_test, "tested"), (by_note, "annotated")):
        # a class's own row has no method
        marks = df.select("kind", "class", F.coalesce("method", F.lit("")).alias("m")).distinct().withColumn(name, F.lit(True))
        out = out.withColumn("m", F.coalesce("method", F.lit(""))).join(marks, ["kind", "class", "m"], "left").drop("m").fillna(False, [name])
    low = F.lit(False)
    if annotated is not None and "annotation" in annotated.columns:
        modified = annotated.filter(F.col("method").isNull() & is_modifier(F.col("annotation"))).select("class").distinct().withColumn("modified", F.lit(True))
        out = out.join(modified, "class", "left")
        low = low | F.coalesce("modified", F.lit(False))
    if external is not None:
        out = out.join(external.select("class").distinct().withColumn("external", F.lit(True)), "class", "left")
        low = low | (F.coalesce("external", F.lit(False)) & (F.col("kind") == "METHOD"))
    reason = F.when(F.col("tested"), "TEST_ONLY").otherwise("NO_REFERENCES")
    sure = F.when(F.col("annotated") | low, "LOW").when(F.col("tested"), "MEDIUM").otherwise("HIGH")
    return out.select("kind", "class", "method", reason.alias("reason"), sure.alias("confidence"))


def metrics(edges: DataFrame, classes: DataFrame, dead: DataFrame, loops: DataFrame) -> DataFrame:
    """One row of counts; mean degrees over classes of distinct class-level calls; zero where there is nothing."""
    calls = edges.filter("caller_class <> callee_class").select("caller_class", "callee_class").distinct()
    one = [
        classes.agg(F.countDistinct("class").alias("classes"), F.countDistinct(N.package_name(F.col("class"))).alias("packages")),
        calls.agg(F.count(F.lit(1)).alias("calls"), F.coalesce(F.count(F.lit(1)) / F.countDistinct("caller_class"), F.lit(0.0)).alias("mean_out"), F.coalesce(F.count(F.lit(1)) / F.countDistinct("callee_class"), F.lit(0.0)).alias("mean_in")),
        dead.agg(F.count(F.when(F.col("kind") == "CLASS", 1)).alias("dead_classes"), F.count(F.when(F.col("kind") == "METHOD", 1)).alias("dead_methods")),
        loops.agg(F.countDistinct("component").alias("cycles")),
    ]
    # aggregates without a key have one row each
    out = one[0]
    for o in one[1:]:
        out = out.crossJoin(F.broadcast(o))
    return out


def dispatched(edges: DataFrame, supers: DataFrame) -> DataFrame:
    """Edges, and for a call of a supertype's method the same call of each direct implementor's."""
    over = edges.join(supers.select(F.col("supertype").alias("callee_class"), "implementor").distinct(), "callee_class").select("caller_class", "caller_method", F.col("implementor").alias("callee_class"), "callee_method")
    return edges.select(*CALL).union(over).distinct()


def call_tree(roots: DataFrame, edges: DataFrame, scratch: Scratch, depth: int = 3, callers: bool = False, supers: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Trees of calls, flat: (root, seq, parent, depth, class, method), in depth-first order.

    roots (class, method). supers (supertype, implementor): calls of a supertype reach its implementors.
    keep: a filter of edges by their far end (see search.call_filter); roots are not filtered. Children are sorted by name. A tree expands a method once, where it
    comes first in that order above the last depth; elsewhere it is a leaf.

    A place in a tree is its path of names, and paths sort depth first. In rounds, every method's place is the least
    path that the places found so far lead to, until none moves: each round puts at least the next method in order
    where it belongs. Rounds are joins and map-side minima, so a root with very many calls is spread out.
    """
    a, b = (("callee_class", "callee_method"), ("caller_class", "caller_method")) if callers else (("caller_class", "caller_method"), ("callee_class", "callee_method"))
    name = lambda c: F.concat_ws(".", *c)
    edges = edges if supers is None else dispatched(edges, supers)
    edges = edges if keep is None else keep(edges)
    e = scratch.keep(edges.select(name(a).alias("node"), name(b).alias("tgt"), F.col(b[0]).alias("class"), F.col(b[1]).alias("method")).distinct())
    start = scratch.keep(roots.select(name(("class", "method")).alias("root"), "class", "method").distinct())
    top = start.select("root", F.col("root").alias("node"), F.array().cast("array<string>").alias("path"), "class", "method")

    def led(places: DataFrame) -> DataFrame:
        """The top, and what the methods at their places call."""
        below = places.filter(F.size("path") < depth).join(e, "node").select("root", F.col("tgt").alias("node"), F.concat("path", F.array("tgt")).alias("path"), "class", "method")
        return top.union(below)

    now = scratch.keep(top.select("root", "node", "path"))
    while True:
        after = scratch.keep(led(now).filter(F.size("path") < depth).groupBy("root", "node").agg(F.min("path").alias("path")))
        moved = not after.join(now, ["root", "node", "path"], "left_anti").isEmpty()
        scratch.drop(now)
        now = after
        if not moved:
            break
    order = Window.partitionBy("root").orderBy("path")
    rows = scratch.keep(led(now).withColumn("seq", F.row_number().over(order) - 1))
    # of a place only its own path leads on, so a parent is told by root and path
    up = rows.select("root", F.col("path").alias("above"), F.col("seq").alias("parent"))
    rows = rows.withColumn("above", F.when(F.size("path") > 0, F.slice("path", F.lit(1), F.greatest(F.size("path") - 1, F.lit(0)))))
    return rows.join(up, ["root", "above"], "left").select("root", "seq", F.coalesce("parent", F.lit(-1)).alias("parent"), F.size("path").alias("depth"), "class", "method")


def hierarchy(supers: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, ancestor, depth): every supertype above a class and its least distance."""
    direct = scratch.keep(supers.select(F.col("implementor").alias("class"), F.col("supertype").alias("ancestor")).filter("class <> ancestor").distinct())
    known = new = direct.withColumn("depth", F.lit(1))
    for at in range(2, 10_000):
        step = new.select("class", F.col("ancestor").alias("via")).join(direct.select(F.col("class").alias("via"), "ancestor"), "via").select("class", "ancestor").filter("class <> ancestor").distinct()
        new = scratch.keep(step.join(known, ["class", "ancestor"], "left_anti").withColumn("depth", F.lit(at)))
        if new.isEmpty():
            return known
        known = known.union(new) if at % 32 else scratch.keep(known.union(new))
    raise RuntimeError("hierarchy did not end")


TYPES = "root string, seq int, parent int, depth int, class string, kind string"


def type_tree(index: DataFrame, scratch: Scratch, pattern: str = "", project_only: bool = False, most: int = 10_000) -> DataFrame:
    """Trees of supertypes, flat: (root, seq, parent, depth, class, kind), in depth-first order, the superclass first.

    index (class, supertype, kind CLASS or INTERFACE, place among a class's supertypes); supertype is null
    in the row of a class without any. Roots are the index's classes that match (case does not count). In
    a tree a type comes once, where it is met first; project_only leaves out those that are not in the index.
    """
    known = scratch.keep(index.select("class").distinct().withColumn("inside", F.lit(True)))
    direct = index.filter("supertype is not null").select("class", "supertype", "kind", "place").join(known.select(F.col("class").alias("supertype"), "inside"), "supertype", "left")
    direct = scratch.keep(direct.select("class", "supertype", "kind", "place", F.coalesce("inside", F.lit(False)).alias("inside")).distinct())
    start = known.filter(F.col("class").rlike("(?i)" + pattern)).select(F.col("class").alias("root"), "class")
    ups = direct.select("class", F.col("supertype").alias("next")).distinct()
    near = fixpoint(start, lambda now: now.join(ups, "class").select("root", F.col("next").alias("class")), scratch, most)
    reach = near.join(direct, "class").select("root", "class", "supertype", "kind", "place", "inside")
    none = start.select("root", "class", F.lit(None).cast("string").alias("supertype"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("place"), F.lit(True).alias("inside"))

    def tree(root, rows):
        above: dict[str, list] = {}
        for _, c, up, kind, place, inside in rows:
            if up is not None:
                above.setdefault(c, []).append((kind != "CLASS", place, up, kind, inside))
        yield root, 0, -1, 0, root, "ROOT"
        # a type is met in depth-first order; what an outside type would show below it has no rows
        seq, seen, stack = 1, set(), [(x, 0, 1) for x in sorted(above.get(root, []), reverse=True)]
        while stack:
            (_, _, up, kind, inside), parent, at = stack.pop()
            if up in seen:
                continue
            seen.add(up)
            if project_only and not inside:
                continue
            yield root, seq, parent, at, up, kind
            stack += [(x, seq, at + 1) for x in sorted(above.get(up, []), reverse=True)]
            seq += 1

    def order(batches):
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = (r for root, group in groupby(rows, itemgetter(0)) for r in tree(root, group))
        while part := list(islice(out, 10_000)):
            kinds = (pa.string(), *[pa.int32()] * 3, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names=["root", "seq", "parent", "depth", "class", "kind"])

    return reach.unionByName(none).repartition("root").sortWithinPartitions("root").mapInArrow(order, TYPES)
