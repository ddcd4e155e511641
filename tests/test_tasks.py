"""Tasks by name, on classes and changes made here."""

import datetime
import shutil
import subprocess

import pytest

from sparkloom import tasks as T
from sparkloom.sources import bytecode as B

SOURCES = {
    "a/Shape.java": "package a; public interface Shape { double area(); }",
    "a/Box.java": 'package a; public class Box implements Shape { public double area() { return b.Store.load(this); } public String unused() { return "never said"; } }',
    "b/Store.java": "package b; public class Store { public static double load(Object o) { return new a.Box().area(); } }",
    "b/Lost.java": "package b; @Deprecated public class Lost { public void gone() {} }",
    "t/BoxTest.java": "package t; public class BoxTest { public void check() { new a.Box().unused(); } }",
}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    root = tmp_path_factory.mktemp("tasks")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    main = [str(root / n) for n in SOURCES if not n.startswith("t/")]
    subprocess.run(["javac", "-g", "-d", str(root / "main"), *main], check=True)
    subprocess.run(["javac", "-g", "-cp", str(root / "main"), "-d", str(root / "test"), str(root / "t/BoxTest.java")], check=True)
    facts = B.read_classes(spark, [str(root / "main")]).union(B.read_classes(spark, [str(root / "test")], "test")).cache()
    day = datetime.date(2024, 1, 5)
    rows = [("h1", day, "x", "src/main/kotlin/a/Box.kt", 3, 1), ("h2", day, "y", "src/main/kotlin/a/Box.kt", 1, 0), ("h2", day, "y", "src/main/kotlin/b/Store.kt", 2, 2)]
    changes = spark.createDataFrame([(int(h[1:]), h, *r) for h, *r in rows], "commit_seq int, hash string, date date, author string, path string, added int, deleted int")
    files = spark.createDataFrame([("a.kt", 10), ("b.kt", 30)], "file string, lines long")
    texts = spark.createDataFrame([(f"{k}.kt", f"fun f{k}() {{ " + " ".join(f"x{j} = y{j} + {j}" for j in range(30)) + " }") for k in range(3)], "file string, text string")
    diff = lambda ref: spark.createDataFrame([("src/main/java/b/Store.java",), ("README.md",)] if ref == "main" else [], "path string")
    return T.Inputs(spark, facts, lambda after, follow: changes.filter(changes.date > after), files, texts=texts, changed=diff)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_parse():
    p = T.parse("find-callers", {"pattern": "x", "maxdepth": "bad", "project-only": "false"})
    assert p == {"pattern": "x", "maxdepth": 3, "project-only": False, "filter-synthetic": True, "scope": "all"}
    assert T.parse("dead", {"treat-as-dead": " spring, ,jpa"})["treat-as-dead"] == ["spring", "jpa"]
    p = T.parse("churn", {"after": "2024-02-03", "no-follow": None, "top": "7"})
    assert (p["after"], p["no-follow"], p["top"]) == (datetime.date(2024, 2, 3), True, 7)
    assert T.parse("churn", {})["no-follow"] is False and T.parse("distance", {})["top"] is None
    for task, bad in (("churn", {"pattern": "x"}), ("distance", {"top": "0"}), ("nothing", {})):
        with pytest.raises(ValueError):
            T.parse(task, bad)


def test_structure(inputs):
    go = lambda name, **p: T.run(inputs, name, **p)
    assert rows(go("find-class", pattern="Box"), "class") == [("a.Box",), ("t.BoxTest",)]
    assert rows(go("list-classes", scope="test"), "class") == [("t.BoxTest",)]
    tree = rows(go("find-callers", pattern="Store.load"), "depth", "class", "method")
    assert (0, "b.Store", "load") in tree and (1, "a.Box", "area") in tree
    assert rows(go("find-interfaces", pattern="Shape"), "supertype", "implementors") == [("a.Shape", "a.Box")]
    assert rows(go("package-deps", package="^a$"), "package", "uses") == [("a", "b")]
    assert rows(go("package-deps", package="^a$", reverse="true"), "package", "used_by") == [("a", "b"), ("a", "t")]
    assert {r[:2] for r in rows(go("cycles"), "src", "tgt")} == {("a", "b"), ("b", "a")}
    assert rows(go("find-usages", owner_class="Store", method="load"), "caller_class", "caller_method") == [("a.Box", "area")]
    assert rows(go("find-string-constant", pattern="never"), "class", "method") == [("a.Box", "unused")]
    assert rows(go("annotations", pattern="Deprecated"), "class") == [("b.Lost",)]
    assert rows(go("type-hierarchy", pattern="a.Box"), "class", "kind")[0] == ("a.Box", "ROOT")
    dead = {(r["class"], r.method): (r.reason, r.confidence) for r in go("dead").collect()}
    assert dead[("b.Lost", None)] == ("NO_REFERENCES", "LOW") and dead[("a.Box", "unused")][0] == "TEST_ONLY"
    for name in ("rank", "complexity", "distance", "strength", "dsm"):
        assert go(name).count() > 0
    with pytest.raises(ValueError):
        go("find-class")


def test_history(inputs):
    go = lambda name, **p: T.run(inputs, name, after="2024-01-01", **p)
    assert rows(go("hotspots", min_revs="2"), "path", "revisions") == [("src/main/kotlin/a/Box.kt", 2)]
    assert go("churn").count() == go("code-age").count() == go("authors").count() == go("volatility").count() == 2
    assert go("coupling", min_shared_revs="1", min_coupling="1").count() == 1
    assert T.run(inputs, "churn", after="2024-02-01").count() == 0
    assert rows(T.run(inputs, "size", over="20"), "file") == [("b.kt",)]


def test_more_tasks(inputs):
    go = lambda name, **p: T.run(inputs, name, **p)
    (m,) = go("metrics", after="2024-01-01", top="1").collect()
    assert m.classes == go("list-classes").count() and m.cycles == 1 and [tuple(x) for x in m.top_hotspots] == [("src/main/kotlin/a/Box.kt", 2)]
    assert {r[:2] for r in rows(go("balance", after="2024-01-01"), "src", "tgt")} >= {("a", "b"), ("b", "a")}
    layers = '{"layers": [{"name": "low", "patterns": ["Store"]}, {"name": "high", "patterns": ["*"], "peerLimit": -1}]}'
    assert {("a.Box", "b.Store")} <= set(rows(go("layer-check", config=layers), "src_class", "tgt_class"))
    assert rows(go("layer-check", init="true"), "layer")[-1:] == [("domain",)]
    assert ("b.Store", 1) in rows(go("changed-since", ref="main"), "class", "callers")
    parts = {r.part for r in go("context", pattern="Box").collect()}
    assert {"details", "callers", "callees", "supertypes"} <= parts and T.parse("context", {"pattern": "x"})["maxdepth"] == 2
    got = rows(go("duplicates", min_tokens="50"), "file_a", "file_b", "length")
    assert [x[:2] for x in got] == [("0.kt", "1.kt"), ("0.kt", "2.kt")]
    for task in ("layer-check", "changed-since", "context"):
        with pytest.raises(ValueError):
            go(task)
