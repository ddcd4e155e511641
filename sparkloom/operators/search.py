"""Finding classes, symbols and methods by pattern; filters of call graphs and of dead code; one class in context."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from sparkloom.functions import names as N
from sparkloom.operators.navigation import call_tree, generated_method
from sparkloom.util import Scratch

#: Words that a pattern may leave out.
SMALL_WORDS = ("And", "Or", "Of", "The", "For", "In", "To", "By", "On", "With")


def enhance(pattern: str) -> str:
    """A plain camel-case word becomes a regex of its parts in order, small words optional; all else is left as it is."""
    if re.search(r"[.*+?|\[\](){}^$\\]", pattern):
        return pattern
    first, *rest = re.split(r"(?<=[a-z])(?=[A-Z])", pattern)
    return first + "".join(f"(?:{part})?" if part in SMALL_WORDS else f".*{part}" for part in rest)


def find_classes(classes: DataFrame, pattern: str) -> DataFrame:
    """Rows of (class, source_file, source_path, ...) that a person wrote and that match, in order of name."""
    hit = N.name_filter(enhance(pattern), F.col("class"), F.col("source_path"), N.simple_name(F.col("class")), F.col("source_file"))
    return classes.filter(F.col("user_defined") & hit).orderBy("class")


def find_symbols(symbols: DataFrame, pattern: str) -> DataFrame:
    """Rows of (package, class, symbol, ...): with a dot the qualified name is searched, else the symbol's own."""
    p = "(?i)" + enhance(pattern)
    name = F.concat_ws(".", "class", "symbol") if "." in pattern else F.col("symbol")
    return symbols.filter(name.rlike(p)).orderBy("package", "class", "symbol")


def method_patterns(pattern: str) -> list[str]:
    """The regexes that are tried in turn: as given, in nested classes too, and as a property's accessor."""
    at, n = (pattern.rfind("\\."), 2) if "\\." in pattern else (pattern.rfind("."), 1)
    owner, method = (pattern[:at], pattern[at + n :]) if at >= 0 else ("", "")
    if not method:
        return [pattern]
    nested = owner + r"(?:\$\w+)*\."
    title = method[:1].upper() + method[1:]
    return [pattern, nested + method, f"{nested}(?:get{title}|set{title}|is{title})"]


def find_methods(edges: DataFrame, pattern: str) -> DataFrame:
    """(class, method) of call edges' ends that match the first of the patterns that any method matches."""
    ends = edges.select(F.col("caller_class").alias("class"), F.col("caller_method").alias("method")).union(edges.select("callee_class", "callee_method")).distinct()
    name = F.concat_ws(".", "class", "method")
    hit = ends.limit(0)
    for p in method_patterns(pattern):
        hit = ends.filter(name.rlike("(?i)" + p))
        if not hit.isEmpty():
            break
    return hit.orderBy(name)


def call_filter(edges: DataFrame, side: str, project: DataFrame | None = None, generated: bool = True, sets: DataFrame | None = None, scope: str = "all") -> DataFrame:
    """Edges whose end on a side (caller or callee) is a project class, not generated, and in scope.

    project (class); sets (class, source_set); scope all, prod or test: a class without a set counts as prod.
    """
    cls = f"{side}_class"
    if project is not None:
        edges = edges.join(project.select(F.col("class").alias(cls)).distinct(), cls, "left_semi")
    if not generated:
        edges = edges.filter(~N.is_generated(F.col(cls)) & ~generated_method(F.col(f"{side}_method")))
    if scope != "all" and sets is not None:
        marked = edges.join(sets.select(F.col("class").alias(cls), "source_set"), cls, "left")
        edges = marked.filter(F.coalesce("source_set", F.lit("prod")) == scope).drop("source_set")
    return edges.select("caller_class", "caller_method", "callee_class", "callee_method")


def _marked(c: str, values: Iterable[str]) -> Column:
    values = list(values)
    return F.col(c).isin(values) | F.element_at(F.split(c, r"\."), -1).isin(values)


def dead_code_filters(
    dead: DataFrame,
    pattern: str | None = None,
    exclude: str | None = None,
    methods: DataFrame | None = None,
    notes: DataFrame | None = None,
    entry_annotations: Iterable[str] = (),
    supers: DataFrame | None = None,
    entry_supertypes: Iterable[str] = (),
    receivers: DataFrame | None = None,
    entry_receivers: Iterable[str] = (),
    tests: DataFrame | None = None,
    scope: str = "all",
) -> DataFrame:
    """Rows of dead code (kind, class, method, reason, ...) that stay, in order of kind, class and method.

    methods (class, method): accessors, bridges, inline and delegated methods, which are never dead.
    notes (class, method, annotation): an entry annotation, by full or simple name, on the class or on
    the method keeps it alive. supers (supertype, implementor): so do entry supertypes, and
    receivers (class, receiver) entry receivers for file facades. scope prod leaves out what tests
    use and test classes (class); scope test keeps what only tests use.
    """
    if pattern is not None:
        dead = dead.filter(F.col("class").rlike(pattern))
    if exclude is not None:
        dead = dead.filter(~F.col("class").rlike(exclude))
    if methods is not None:
        dead = dead.join(methods.select("class", "method").distinct(), ["class", "method"], "left_anti")
    if notes is not None and entry_annotations:
        hit = notes.filter(_marked("annotation", entry_annotations))
        dead = dead.join(hit.filter("method is null").select("class").distinct(), "class", "left_anti")
        dead = dead.join(hit.filter("method is not null").select("class", "method").distinct(), ["class", "method"], "left_anti")
    if supers is not None and entry_supertypes:
        dead = dead.join(supers.filter(F.col("supertype").isin(list(entry_supertypes))).select(F.col("implementor").alias("class")).distinct(), "class", "left_anti")
    if receivers is not None and entry_receivers:
        hit = receivers.filter(F.col("receiver").isin(list(entry_receivers)) & F.col("class").endswith("Kt"))
        dead = dead.join(hit.select("class").distinct(), "class", "left_anti")
    if scope == "prod":
        dead = dead.filter("reason = 'NO_REFERENCES'")
        if tests is not None:
            dead = dead.join(tests.select("class").distinct(), "class", "left_anti")
    elif scope == "test":
        dead = dead.filter("reason = 'TEST_ONLY'")
    return dead.select("kind", "class", "method", *(c for c in dead.columns if c not in ("kind", "class", "method"))).orderBy("kind", "class", F.coalesce("method", F.lit("")))


def context(details: DataFrame, edges: DataFrame, supers: DataFrame, scratch: Scratch, pattern: str, depth: int = 2) -> dict[str, DataFrame]:
    """What surrounds the classes that match: details, caller and callee trees, implementors, supertypes."""
    hit = F.col("class").rlike("(?i)" + pattern)
    own = lambda side: edges.select(F.col(f"{side}_class").alias("class"), F.col(f"{side}_method").alias("method"))
    roots = own("caller").union(own("callee")).filter(hit & ~generated_method(F.col("method"))).distinct()
    return {
        "details": details.filter(hit),
        "callers": call_tree(roots, edges, scratch, depth, callers=True),
        "callees": call_tree(roots, edges, scratch, depth),
        "implementors": supers.filter(F.col("supertype").rlike("(?i)" + pattern)),
        "supertypes": supers.filter(F.col("implementor").rlike("(?i)" + pattern)),
    }


#: Usual layers and the names that tell them, outermost first.
LAYERS = (("http", ("*Controller", "*Routes", "*Endpoint", "*Resource")), ("service", ("*Service",)), ("adapter", ("*Repository", "*Client", "*Cache", "*Sender", "*Dao")))


def layer_proposal(classes: DataFrame) -> list[dict]:
    """Layers whose patterns match some class, each with those patterns, then a domain of all else."""
    simple = N.simple_name(F.col("class"))
    flags = {p: F.coalesce(F.bool_or(simple.endswith(p[1:])), F.lit(False)) for _, patterns in LAYERS for p in patterns}
    row = classes.agg(*(c.alias(p) for p, c in flags.items())).first()
    out = [{"name": name, "patterns": [p for p in patterns if row[p]]} for name, patterns in LAYERS]
    return [layer for layer in out if layer["patterns"]] + [{"name": "domain", "patterns": ["*"]}]
