"""Tasks by name: parameters given as text are checked and parsed, and an analysis of the inputs comes back."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.operators import clones, graph as G, history as H, navigation as V, packages as P, presets as R, renames as M, search as S
from sparkloom.sources import bytecode as B, tokens as T
from sparkloom.util import Scratch

#: Parameters, their kind and default. A flag is set by being there; a date is by default a year ago.
PARAMS = {
    "pattern": ("text", None), "method": ("text", None), "maxdepth": ("int", "3"), "project-only": ("bool", "true"), "filter-synthetic": ("bool", "true"),
    "top": ("int", "50"), "over": ("int", "0"), "after": ("date", None), "no-follow": ("flag", None), "min-revs": ("int", "1"), "package": ("text", None),
    "reverse": ("bool", None), "package-filter": ("text", None), "include-external": ("bool", "false"), "dsm-depth": ("int", "2"), "cycles": ("bool", None),
    "owner-class": ("text", None), "field": ("text", None), "type": ("text", None), "outside-package": ("text", None), "filter": ("text", None), "exclude": ("text", None),
    "classes-only": ("bool", None), "exclude-annotated": ("list", None), "scope": ("text", "all"), "group-by": ("text", "none"), "treat-as-dead": ("list", None),
    "collapse-lambdas": ("bool", "true"), "min-shared-revs": ("int", "5"), "min-coupling": ("int", "30"), "max-changeset-size": ("int", "30"), "methods": ("bool", "false"),
    "ref": ("text", None), "config": ("text", None), "init": ("bool", "false"), "min-tokens": ("int", "50"),
    "target-class": ("text", None), "param": ("text", None), "property": ("text", None), "new-name": ("text", None), "from": ("text", None), "to": ("text", None),
    "preview": ("flag", None),
}

#: Defaults that differ by task.
OTHER = {("context", "maxdepth"): "2"}


@dataclass
class Inputs:
    """What tasks read: facts of class files, changes(after, follow renames) of the history, (file, lines) of sources, and more."""

    spark: SparkSession
    facts: DataFrame | None = None
    changes: Callable[[datetime.date, bool], DataFrame] | None = None
    files: DataFrame | None = None
    texts: DataFrame | None = None  # (file, text) of sources
    changed: Callable[[str], DataFrame] | None = None  # (path) of files that differ from a revision
    source_sets: tuple[str, ...] = ("prod", "test")

    def scratch(self, name: str) -> Scratch:
        return Scratch(self.spark, name)

    def of(self, scope: str) -> DataFrame:
        """Facts of a source set."""
        if scope not in ("all", "prod", "test"):
            raise ValueError(f"scope is all, prod or test, not {scope}")
        return self.facts if scope == "all" else self.facts.filter(F.col("source_set") == scope)


def parsed(kind: str, value: str | None, default: str | None):
    if kind == "int":
        for text in (value, default):
            try:
                return int(text)
            except (TypeError, ValueError):
                continue
        return 0
    if kind == "bool":
        return ((default if value is None else value) or "").lower() == "true"
    if kind == "list":
        return [x for x in map(str.strip, (value or "").split(",")) if x]
    if kind == "date":
        if value is not None:
            return datetime.date.fromisoformat(value)
        today = datetime.date.today()
        return today.replace(year=today.year - 1, day=28 if (today.month, today.day) == (2, 29) else today.day)
    return default if value is None else value


def parse(task: str, given: dict[str, str | None]) -> dict:
    """All parameters of a task by name; unknown ones are refused, a bad number counts as the default."""
    names, wide, _ = _task(task)
    if unknown := sorted(set(given) - set(names)):
        raise ValueError(f"{task} does not know {', '.join(unknown)}; it knows {', '.join(sorted(names))}")
    out = {}
    for name in names:
        kind, default = PARAMS[name]
        default = OTHER.get((task, name), default)
        if name == "top" and wide:  # without a limit unless one is given
            out[name] = None if given.get(name) in (None, "all") else int(given[name])
            if out[name] is not None and out[name] < 1:
                raise ValueError("top must be 1 or more")
            continue
        out[name] = name in given if kind == "flag" else parsed(kind, given.get(name), default)
    return out


def _need(p: dict, name: str) -> str:
    if p[name] is None:
        raise ValueError(f"{name} is missing")
    return p[name]


def _deps(i: Inputs, p: dict) -> DataFrame:
    return B.package_deps(i.of(p["scope"]), p["include-external"], p["package-filter"] or "")


def _packages(i: Inputs, p: dict) -> DataFrame:
    deps = B.package_deps(i.of(p["scope"]), not p["project-only"])
    rows = P.dependents(deps) if p["reverse"] else deps.select(F.col("src_pkg").alias("package"), F.col("tgt_pkg").alias("uses")).distinct()
    return rows if p["package"] is None else rows.filter(F.col("package").rlike("(?i)" + p["package"]))


def _tree(callers: bool):
    def run(i: Inputs, p: dict) -> DataFrame:
        edges, side = B.call_edges(i.facts), "caller" if callers else "callee"
        project = B.classes(i.facts).select("class") if p["project-only"] else None
        keep = lambda e: S.call_filter(e, side, project, not p["filter-synthetic"], B.source_sets(i.facts, list(i.source_sets)), p["scope"])
        return V.call_tree(S.find_methods(edges, _need(p, "pattern")), edges, i.scratch("tree"), p["maxdepth"], callers, B.supertypes(i.facts), keep)

    return run


def _types(i: Inputs, p: dict) -> DataFrame:
    rows = B.class_index(i.of(p["scope"]))
    face = F.transform("interfaces", lambda t, k: F.struct(t.alias("supertype"), F.lit("INTERFACE").alias("kind"), (k + 1).cast("int").alias("place")))
    above = F.concat(F.array(F.struct(F.col("super_class").alias("supertype"), F.lit("CLASS").alias("kind"), F.lit(0).alias("place"))), face)
    return V.type_tree(rows.select("class", F.inline(above)), i.scratch("types"), S.enhance(_need(p, "pattern")), p["project-only"])


def _usages(i: Inputs, p: dict) -> DataFrame:
    found = B.find_usages(i.of(p["scope"]), p["owner-class"] and S.enhance(p["owner-class"]), p["method"], p["field"], p["type"] and S.enhance(p["type"]), p["outside-package"], not p["filter-synthetic"])
    return found.groupBy("source_file").agg(F.count(F.lit(1)).alias("sites")) if p["group-by"] == "file" else found


def _project_edges(i: Inputs, p: dict) -> DataFrame:
    edges = B.call_edges(i.of(p["scope"]))
    if p["project-only"]:
        own = B.classes(i.facts).select("class")
        for side in ("caller", "callee"):
            edges = S.call_filter(edges, side, own)
    return G.collapsed(edges) if p["collapse-lambdas"] else edges


def _rank(i: Inputs, p: dict) -> DataFrame:
    edges = _project_edges(i, p).select(F.col("caller_class").alias("src"), F.col("callee_class").alias("tgt"))
    return H.top(G.pagerank(edges, i.scratch("rank")), p["top"], F.desc("rank"), "node")


def _complexity(i: Inputs, p: dict) -> DataFrame:
    rows = G.complexity(_project_edges(i, p))
    rows = rows if p["pattern"] is None else rows.filter(F.col("class").rlike("(?i)" + S.enhance(p["pattern"])))
    return H.top(rows, p["top"], F.desc(F.col("fan_in") + F.col("fan_out")), "class")


def _dead(i: Inputs, p: dict) -> DataFrame:
    f, notes, supers = i.facts, B.annotations(i.facts), B.supertypes(i.facts).select("supertype", "implementor")
    sets = B.source_sets(f, list(i.source_sets))
    tests = sets.filter("source_set = 'test'").select("class")
    edges = B.call_edges(f)
    by_test = lambda how: edges.join(tests.withColumnRenamed("class", "caller_class"), "caller_class", how)
    tested = by_test("left_semi").select(F.col("callee_class").alias("class"), F.col("callee_method").alias("method")).distinct()
    alive = B.bridge_methods(f).union(B.inline_methods(f)).union(B.delegated_methods(f)).union(B.field_accessors(f))
    dead = V.dead_code(by_test("left_anti"), B.classes(f).filter("user_defined").select("class"), B.declared_methods(f), supers, i.scratch("dead"), tested, notes)
    entry = notes.filter(R.is_entry_point(F.col("annotation"), p["treat-as-dead"]))
    names = [r.annotation for r in entry.select("annotation").distinct().collect()]  # as many as presets tell apart
    out = S.dead_code_filters(dead, p["filter"], p["exclude"], alive, notes, [*names, *p["exclude-annotated"]], tests=tests, scope=p["scope"])
    return out.filter("kind = 'CLASS'") if p["classes-only"] else out


def _loops(i: Inputs, p: dict) -> DataFrame:
    deps = _deps(i, p)
    return P.cycle_edges(G.cycles(P.dsm(deps, p["dsm-depth"]).select("src", "tgt"), i.scratch("loops")), deps, p["dsm-depth"])


def _dsm(i: Inputs, p: dict) -> DataFrame:
    cells = P.dsm(_deps(i, p), p["dsm-depth"])
    return P.two_cycles(cells) if p["cycles"] else cells


def _log(i: Inputs, p: dict) -> DataFrame:
    return i.changes(p["after"], not p["no-follow"])


def _metrics(i: Inputs, p: dict) -> DataFrame:
    """Counts, and the files that change most (path and revisions), most changed first."""
    all_of = {k: parsed(kind, None, default) for k, (kind, default) in PARAMS.items()}
    pairs = _deps(i, all_of | p).select(F.col("src_pkg").alias("src"), F.col("tgt_pkg").alias("tgt")).distinct()
    loops = G.cycles(pairs, i.scratch("loops"))
    row = V.metrics(_project_edges(i, all_of | p), B.classes(i.of(p["scope"])).filter("user_defined"), _dead(i, all_of | p), loops)
    spots = H.hotspots(_log(i, p), 1, p["top"]).agg(F.sort_array(F.collect_list(F.struct((-F.col("revisions")).alias("m"), "path"))).alias("s"))
    named = F.transform("s", lambda x: F.struct(x["path"].alias("path"), (-x["m"]).alias("revisions")))
    return row.crossJoin(F.broadcast(spots.select(named.alias("top_hotspots"))))  # one row each


def _balance(i: Inputs, p: dict) -> DataFrame:
    changes = H.volatility(H.hotspots(_log(i, p), 1, None), H.package_of_file(F.col("path")))
    return P.balance(P.strength(_deps(i, p), B.class_kinds(i.facts)), changes)


def _layers(i: Inputs, p: dict) -> DataFrame:
    """Violations of the layers in `config` (JSON, or the path of a file of the driver); with init the layers that fit the classes."""
    if p["init"]:
        rows = [(k, x["name"], x["patterns"]) for k, x in enumerate(S.layer_proposal(B.classes(i.of(p["scope"])).filter("user_defined")))]
        return i.spark.createDataFrame(rows, "place int, layer string, patterns array<string>")
    text = _need(p, "config")
    if not text.lstrip().startswith("{"):
        with open(text, encoding="utf-8") as f:
            text = f.read()
    return P.layer_check(_deps(i, p), P.parse_layers(text))


def _changed(i: Inputs, p: dict) -> DataFrame:
    edges = B.call_edges(i.of(p["scope"]))
    edges = S.call_filter(edges, "caller", B.classes(i.facts).select("class")) if p["project-only"] else edges
    sources = B.classes(i.facts).select("class", F.col("source_path").alias("path"))
    return V.changed_since(i.changed(_need(p, "ref")), sources, edges)[0]


def _context(i: Inputs, p: dict) -> DataFrame:
    """(part, row): everything around the classes that match, each row as JSON under the name of its part."""
    f = i.of(p["scope"])
    supers = B.supertypes(f).select("supertype", "implementor")
    parts = S.context(B.class_details(f), B.call_edges(f), supers, i.scratch("context"), S.enhance(_need(p, "pattern")), p["maxdepth"])
    rows = [d.select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("row")) for name, d in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def _sites(preview: Callable[[DataFrame, DataFrame, Scratch], DataFrame], **columns: str):
    """What changing one class or member would touch: parameters by the targets' columns."""

    def run(i: Inputs, p: dict) -> DataFrame:
        if not p["preview"]:
            raise ValueError("sources are not rewritten here: ask for a preview")
        row = tuple(_need(p, n) for n in columns.values())
        return preview(i.facts, i.spark.createDataFrame([row], ", ".join(f"{c} string" for c in columns)), i.scratch("sites"))

    return run


_DEPS, _LOG = "package-filter include-external dsm-depth scope", "after no-follow"
#: name: (parameters, top without a limit, what it runs)
TASKS: dict[str, tuple[str, bool, Callable[[Inputs, dict], DataFrame]]] = {
    "list-classes": ("pattern scope", False, lambda i, p: S.find_classes(B.classes(i.of(p["scope"])).filter("user_defined"), S.enhance(p["pattern"] or ""))),
    "find-class": ("pattern scope", False, lambda i, p: S.find_classes(B.classes(i.of(p["scope"])), S.enhance(_need(p, "pattern")))),
    "find-symbol": ("pattern scope", False, lambda i, p: S.find_symbols(B.symbols(i.of(p["scope"])), S.enhance(_need(p, "pattern")))),
    "class-detail": ("pattern scope", False, lambda i, p: B.class_details(i.of(p["scope"]), S.enhance(_need(p, "pattern")))),
    "find-callers": ("pattern maxdepth project-only filter-synthetic scope", False, _tree(True)),
    "find-callees": ("pattern maxdepth project-only filter-synthetic scope", False, _tree(False)),
    "find-interfaces": ("pattern scope", False, lambda i, p: V.implementors(B.supertypes(i.of(p["scope"])), S.enhance(_need(p, "pattern")))),
    "type-hierarchy": ("pattern project-only scope", False, _types),
    "package-deps": ("package project-only reverse scope", False, _packages),
    "dsm": (f"{_DEPS} cycles", False, _dsm),
    "cycles": (_DEPS, False, _loops),
    "distance": (f"{_DEPS} top", True, lambda i, p: P.distances(P.dsm(_deps(i, p), p["dsm-depth"]), p["top"])),
    "strength": (f"{_DEPS} top", True, lambda i, p: P.strength(_deps(i, p), B.class_kinds(i.facts), p["top"])),
    "find-usages": ("owner-class method field type outside-package filter-synthetic scope group-by", False, _usages),
    "rank": ("top project-only collapse-lambdas scope", False, _rank),
    "complexity": ("pattern project-only collapse-lambdas top scope", False, _complexity),
    "dead": ("filter exclude classes-only exclude-annotated scope treat-as-dead", False, _dead),
    "find-string-constant": ("pattern scope", False, lambda i, p: B.string_constants(i.of(p["scope"]), _need(p, "pattern"))),
    "annotations": ("pattern methods scope", False, lambda i, p: B.annotated(B.annotations(i.of(p["scope"])), S.enhance(_need(p, "pattern")), p["methods"])),
    "hotspots": (f"{_LOG} min-revs top", False, lambda i, p: H.hotspots(_log(i, p), p["min-revs"], p["top"])),
    "churn": (f"{_LOG} top", False, lambda i, p: H.churn(_log(i, p), p["top"])),
    "code-age": (f"{_LOG} top", False, lambda i, p: H.code_age(_log(i, p), F.current_date(), p["top"])),
    "authors": (f"{_LOG} min-revs top", False, lambda i, p: H.authors(_log(i, p), p["min-revs"], p["top"])),
    "coupling": (f"{_LOG} min-shared-revs min-coupling max-changeset-size top", False, lambda i, p: H.coupling(_log(i, p), p["min-shared-revs"], p["min-coupling"], p["max-changeset-size"], p["top"])),
    "volatility": (f"{_LOG} min-revs top", False, lambda i, p: H.volatility(H.hotspots(_log(i, p), p["min-revs"], None), H.package_of_file(F.col("path")), p["top"])),
    "size": ("top over", False, lambda i, p: H.sizes(i.files, p["over"], p["top"])),
    "metrics": (f"{_LOG} top package-filter include-external project-only collapse-lambdas exclude-annotated treat-as-dead scope", False, _metrics),
    "balance": (f"{_DEPS} {_LOG}", False, _balance),
    "layer-check": (f"{_DEPS} config init", False, _layers),
    "changed-since": ("ref project-only scope", False, _changed),
    "rename-method": ("target-class method new-name preview", False, _sites(M.rename_method, **{"class": "target-class", "method": "method"})),
    "rename-param": ("target-class method param new-name preview", False, _sites(M.rename_parameter, **{"class": "target-class", "method": "method", "param": "param"})),
    "rename-property": ("target-class property new-name preview", False, _sites(lambda f, t, _: M.rename_property(f, t), **{"class": "target-class", "property": "property"})),
    "move-class": ("from to preview", False, _sites(lambda f, t, _: M.move_class(f, t), **{"class": "from", "new_class": "to"})),
    "context": ("pattern maxdepth scope", False, _context),
    "duplicates": ("min-tokens top", False, lambda i, p: H.top(clones.duplicate_groups(T.token_table(i.texts), i.scratch("duplicates"), p["min-tokens"]), p["top"], F.desc("length"), "file_a", "start_a", "file_b", "start_b")),
}


def _task(name: str) -> tuple[list[str], bool, Callable[[Inputs, dict], DataFrame]]:
    if name not in TASKS:
        raise ValueError(f"no task {name}; there are {', '.join(sorted(TASKS))}")
    names, wide, run = TASKS[name]
    return names.split(), wide, run


def run(inputs: Inputs, task: str, **given: str | None) -> DataFrame:
    """The result of a task; parameters as text, with _ for -."""
    given = {k.rstrip("_").replace("_", "-"): v for k, v in given.items()}
    return _task(task)[2](inputs, parse(task, given))
