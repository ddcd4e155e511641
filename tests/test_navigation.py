"""Call trees, duplicate runs and the tokenizer on small fixtures; changed files."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names as N
from sparkloom.operators import duplicates as D, navigation as V, packages as P, presets as R, search as S
from sparkloom.plans import adapters as A
from sparkloom.queries import queries
from sparkloom.sources.tokens import line_counts, read_sources, token_table, tokenize
from sparkloom.util import Scratch


def test_call_tree(spark):
    e = spark.createDataFrame([("A", "a", "B", "b"), ("A", "a", "C", "c"), ("B", "b", "C", "c"), ("C", "c", "A", "a"), ("C", "c", "D", "d")], V.CALL)
    roots = spark.createDataFrame([("A", "a")], "class string, method string")
    rows = V.call_tree(roots, e, Scratch(spark, "t"), depth=3).orderBy("seq").collect()
    # C is expanded once, below B; its second place is a leaf, and A comes again as a leaf
    assert [(r.seq, r.parent, r.depth, r["class"]) for r in rows] == [(0, -1, 0, "A"), (1, 0, 1, "B"), (2, 1, 2, "C"), (3, 2, 3, "A"), (4, 2, 3, "D"), (5, 0, 1, "C")]


def test_call_tree_query(spark):
    """Every declared method is a root."""
    d = "/root/testdata/sf0.001"
    calls: dict = {}
    for a, b, c, m in A.call_edges(spark, d).collect():
        calls.setdefault((a, b), []).append((f"{c}.{m}", c, m))

    def walk(c, m, at, seen):
        yield at, c, m
        if at < 3 and (c, m) not in seen:
            seen.add((c, m))
            for _, x, y in sorted(calls.get((c, m), [])):
                yield from walk(x, y, at + 1, seen)

    got: dict = {}
    for r in queries()["call_tree"](spark, d).orderBy("root", "seq").collect():
        got.setdefault(r.root, []).append((r.depth, r["class"], r.method))
    assert got == {f"{c}.{m}": list(walk(c, m, 0, set())) for c, m in A.declared_methods(spark, d).collect()}


def test_call_tree_dispatch(spark):
    """A call of an interface's method reaches implementors, in both directions; the filter keeps children only."""
    e = spark.createDataFrame([("A", "a", "I", "m"), ("X", "m", "Z", "z"), ("Y", "m", "Z", "z"), ("I", "m", "Q$1", "q")], V.CALL)
    supers = spark.createDataFrame([("I", "X"), ("I", "Y")], "supertype string, implementor string")
    tree = lambda c, m, **k: [(r.depth, r["class"]) for r in V.call_tree(spark.createDataFrame([(c, m)], "class string, method string"), e, Scratch(spark, "t"), **k).orderBy("seq").collect()]
    assert tree("A", "a", supers=supers) == [(0, "A"), (1, "I"), (2, "Q$1"), (1, "X"), (2, "Z"), (1, "Y"), (2, "Z")]
    assert tree("X", "m", supers=supers, callers=True) == [(0, "X"), (1, "A")]
    assert tree("X", "m", callers=True) == [(0, "X")]
    assert tree("A", "a", keep=lambda x: S.call_filter(x, "callee", generated=False)) == [(0, "A"), (1, "I")]


def test_type_tree(spark):
    """The superclass comes first; a type met twice comes once; types outside the project can be left out."""
    rows = [("C", "B", "CLASS", 0), ("C", "J", "INTERFACE", 0), ("C", "I", "INTERFACE", 1), ("B", "I", "INTERFACE", 0), ("I", "K", "INTERFACE", 0), ("J", None, None, 0), ("L", "M", "CLASS", 0), ("M", "L", "CLASS", 0)]
    index = spark.createDataFrame(rows, "class string, supertype string, kind string, place int")
    out = lambda *a: [(r.root, r.seq, r.parent, r.depth, r["class"], r.kind) for r in V.type_tree(index, Scratch(spark, "t"), *a).orderBy("root", "seq").collect()]
    assert out("^c$") == [("C", 0, -1, 0, "C", "ROOT"), ("C", 1, 0, 1, "B", "CLASS"), ("C", 2, 1, 2, "I", "INTERFACE"), ("C", 3, 2, 3, "K", "INTERFACE"), ("C", 4, 0, 1, "J", "INTERFACE")]
    assert [x[4] for x in out("^C$", True)] == ["C", "B", "I", "J"]
    assert [x[4] for x in out("^L$")] == ["L", "M", "L"] and [x[4] for x in out("^J$")] == ["J"] and out("nothing") == []


def test_dead_code_confidence(spark):
    e = spark.createDataFrame([("A", "run", "B", "used"), ("B", "used", "B", "inner")], V.CALL)
    project = spark.createDataFrame([(c,) for c in ("A", "B", "C", "D", "E$1", "p.package-info")], "class string")
    declared = spark.createDataFrame([("B", m) for m in ("used", "inner", "idle", "getSize", "setSize", "getOther", "toString", "x$lambda$0")], "class string, method string")
    none = spark.createDataFrame([], "supertype string, implementor string")
    notes = spark.createDataFrame([("B", None, "io.smallrye.common.annotation.Blocking"), ("D", None, "com.acme.Own")], "class string, method string, annotation string")
    fields = spark.createDataFrame([("B", "size")], "class string, field string")
    rows = V.dead_code(e, project, declared, none, Scratch(spark, "t"), annotated=notes, fields=fields).collect()
    assert {(r["class"], r.method, r.confidence) for r in rows} == {("A", None, "HIGH"), ("C", None, "HIGH"), ("D", None, "LOW"), ("B", "idle", "LOW"), ("B", "getOther", "LOW")}
    rows = V.dead_code(e, project, declared, none, Scratch(spark, "t"), external=spark.createDataFrame([("B",), ("C",)], "class string")).collect()
    assert {(r["class"], r.method): r.confidence for r in rows}[("B", "idle")] == "LOW" and {(r["class"], r.method): r.confidence for r in rows}[("C", None)] == "HIGH"


def test_presets(spark):
    names = {
        "jakarta.persistence.Entity": ("jpa", True), "org.springframework.stereotype.Service": ("spring", True), "org.springframework.cache.annotation.Cacheable": ("spring", False), "io.quarkus.grpc.GrpcService": ("grpc", True),
        "io.quarkus.scheduler.Scheduled": ("quarkus", True), "io.quarkus.grpc.RegisterInterceptor": ("grpc", False), "org.eclipse.microprofile.faulttolerance.Retry": ("microprofile", False), "com.acme.X": (None, False), "org.junit.jupiter.api.Test": ("junit", True),
        "org.springframework.lang.Nullable": (None, False), "jakarta.annotation.Nullable": (None, False), "jakarta.annotation.PostConstruct": ("jakarta", True), "org.springframework.data.annotation.Id": (None, False),
    }
    df = spark.createDataFrame([(n,) for n in names], "a string")
    got = {r.a: (r.f, r.e) for r in df.select("a", R.framework_of(F.col("a")).alias("f"), R.is_entry_point(F.col("a")).alias("e")).collect()}
    assert got == names
    entry = lambda *dead: {r.a for r in df.filter(R.is_entry_point(F.col("a"), dead)).collect()}
    assert entry("ALL") == set()
    # what another preset holds too stays
    assert "jakarta.persistence.Entity" in entry("jpa") and "jakarta.persistence.Entity" not in entry("jpa", "Spring", "quarkus") and "org.junit.jupiter.api.Test" not in entry("junit")
    sup = spark.createDataFrame([("org.springframework.data.jpa.repository.JpaRepository",), ("io.ktor.server.html.Template",), ("com.acme.Repository",)], "a string")
    assert [r.x for r in sup.select(R.is_entry_supertype(F.col("a")).alias("x")).collect()] == [True, True, False]
    assert [r.x for r in sup.select(R.is_entry_supertype(F.col("a"), ["spring", "ktor"]).alias("x")).collect()] == [False] * 3
    other = spark.createDataFrame([("org.springframework.data.custom.OwnRepository",), ("org.springframework.data.repository.CrudRepository",)], "a string")
    assert [r.x for r in other.select(R.is_entry_supertype(F.col("a")).alias("x")).collect()] == [False, True]
    rec = spark.createDataFrame([("io.ktor.server.routing.Route",), ("x.Route",)], "a string")
    assert [r.x for r in rec.select(R.is_entry_receiver(F.col("a")).alias("x")).collect()] == [True, False]


def test_hints(spark):
    roots = spark.createDataFrame([("p.A", "get"), ("p.A", "other"), ("p.B", "run"), ("p.C", "run")], "class string, method string")
    notes = spark.createDataFrame([("p.A", "get", "z.Last"), ("p.A", "get", "jakarta.ws.rs.GET"), ("p.A", None, "org.springframework.stereotype.Service"), ("p.B", None, "org.springframework.lang.Nullable")], "class string, method string, annotation string")
    assert {tuple(r) for r in R.entry_point_hints(roots, notes).collect()} == {
        ("p.A", "get", "@GET is a jaxrs entry point; invoked by the framework at runtime."),
        ("p.A", "other", "@Service is a spring entry point; invoked by the framework at runtime."),
    }


def test_layers(spark):
    layers = P.parse_layers('{"layers": [{"name": "http", "patterns": ["*Controller", "a*b"]}, {"name": "infra", "patterns": ["*Fake*"], "peerLimit": "1", "testInfrastructure": true}, {"name": "domain", "patterns": ["*"], "peerLimit": -1}]}')
    assert [x["peer_limit"] for x in layers] == [0, 1, -1]
    for bad in ("[]", "{}", '{"layers": [1]}', '{"layers": [{"name": "a"}]}', '{"layers": [{"name": "a", "patterns": [], "peerLimit": true}]}', '{"layers": [{"name": "a", "patterns": [], "testInfrastructure": 1}]}'):
        with pytest.raises(ValueError):
            P.parse_layers(bad)
    names = {"UserController": 0, "UserControllerTest": 0, "UserControllerTestKt": 2, "a*b": 0, "aXb": 2, "MyFakeStore": 1, "Kt": 2, "Test": 2, "X": 2}
    df = spark.createDataFrame(list(names.items()), "n string, want int")
    assert df.withColumn("got", P.layer_of(F.col("n"), layers)).filter("want <> got or got is null").collect() == []
    assert {r.n: r.c for r in df.select("n", N.candidate_names(F.col("n")).alias("c")).collect()}["UserControllerTestKt"] == ["UserControllerTest", "UserController"]
    deps = spark.createDataFrame([("p", "q", "p.X", "q.UController"), ("p", "q", "p.AController", "q.BController"), ("p", "q", "p.SomeTest", "q.FakeX"), ("p", "q", "p.Some", "q.FakeX"), ("p", "q", "p.FakeA", "q.FakeB"), ("p", "q", "p.X", "q.Y")], "src_pkg string, tgt_pkg string, src_class string, tgt_class string")
    got = {(r.type, r.src_class, r.tgt_class) for r in P.layer_check(deps, layers).collect()}
    assert got == {("OUTWARD", "p.X", "q.UController"), ("PEER", "p.AController", "q.BController"), ("OUTWARD", "p.Some", "q.FakeX")}
    assert {r["class"] for r in P.unassigned(deps, layers[:1]).collect()} == {"p.X", "p.SomeTest", "q.FakeX", "p.Some", "p.FakeA", "q.FakeB", "q.Y"}


def test_collapse_lambda(spark):
    def loop(x):
        while (y := re.sub(r"\$\d+$", "", x)) != x:
            x = re.sub(r"\$[a-z][^$]*$", "", y)
        return x

    r = random.Random(2)
    cases = ["".join(r.choice(("A", "$1", "$23", "$run", "$Inner", "$lambda", "$")) for _ in range(r.randint(1, 14))) for _ in range(400)] + ["A" + "$x$1" * 30]
    df = spark.createDataFrame([(x, loop(x)) for x in cases], "c string, want string")
    assert df.withColumn("got", N.collapse_lambda(F.col("c"))).filter("want <> got").collect() == []


def test_sources(spark, tmp_path):
    for name, text in {"a/B.kt": "x\ny\n", "C.java": "one", "d.txt": "no", "a/b/E.kt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    files = read_sources(spark, str(tmp_path))
    assert {r.file: r.lines for r in line_counts(files).collect()} == {"a/B.kt": 2, "C.java": 1}


def test_tokenize():
    assert tokenize('val x = "a\nb" // c\n/* d */ y1 ?: 2.5') == [("KEYWORD", "val", 1), ("IDENTIFIER", "x", 1), ("OPERATOR", "=", 1), ("LITERAL", '"a\nb"', 1), ("IDENTIFIER", "y1", 2), ("OPERATOR", "?:", 2), ("LITERAL", "2.5", 2)]
    assert tokenize("") == []


def test_duplicates(spark):
    r = random.Random(3)
    files = {f"f{i}": [r.choice("abc") for _ in range(40)] for i in range(4)}
    files["f4"] = files["f0"][5:30] + ["z"] + files["f0"][5:30]
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in files.items()], "file string, text string")
    sc, least, want = Scratch(spark, "t"), 6, set()
    names = sorted(files)
    for i, f in enumerate(names):
        for g in names[i:]:
            x, y = files[f], files[g]
            for d in range(1 if f == g else -len(x), len(y)):
                a = max(0, -d)
                while a < len(x) and a + d < len(y):
                    n = 0
                    while a + n < len(x) and a + d + n < len(y) and x[a + n] == y[a + d + n]:
                        n += 1
                    cut = min(n, d) if f == g else n
                    if n >= least and cut >= least:
                        want.add((f, a + n - cut, g, a + n - cut + d, cut))
                    a += n + 1
    got = {tuple(x)[:5] for x in D.duplicates(sc.keep(token_table(df)), sc, least).select("file_a", "start_a", "file_b", "start_b", "length").collect()}
    assert got == want


def test_changed_since(spark):
    changed = spark.createDataFrame([("m/src/p/A.kt",), ("q/B.kt",), ("docs/x.md",)], "path string")
    sources = spark.createDataFrame([("p/A.kt", "p.A"), ("q/B.kt", "q.B")], "path string, class string")
    e = spark.createDataFrame([("p.C", "m", "p.A", "n"), ("p.A", "m", "p.A", "n")], V.CALL)
    impact, lost = V.changed_since(changed, sources, e)
    assert {tuple(r) for r in impact.collect()} == {("p.A", 1), ("q.B", 0)}
    assert [r.path for r in lost.collect()] == ["docs/x.md"]
