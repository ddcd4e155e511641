"""Pattern search, filters, context, renderers, covered duplicates."""

import json

from sparkloom.operators import duplicates as D, navigation as V, search as S
from sparkloom.sources import output as O
from sparkloom.util import Scratch

EDGES = [("p.A", "run", "p.B$In", "load"), ("p.B$In", "load", "p.C", "getName"), ("p.C", "getName", "q.D", "x$lambda$0")]


def names(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_enhance():
    assert [S.enhance(p) for p in ("UserService", "ResetThePassword", "user", "a.B", "User.*", "")] == ["User.*Service", "Reset(?:The)?.*Password", "user", "a.B", "User.*", ""]


def test_find(spark):
    e = spark.createDataFrame(EDGES, V.CALL)
    assert names(S.find_methods(e, "a.run"), "class", "method") == [("p.A", "run")]
    assert names(S.find_methods(e, "B.load"), "class", "method") == [("p.B$In", "load")]
    assert names(S.find_methods(e, "C.name"), "method") == [("getName",)]
    assert names(S.find_methods(e, "nothing"), "method") == []
    sets = spark.createDataFrame([("p.C", "test")], "class string, source_set string")
    project = spark.createDataFrame([("p.C",), ("q.D",)], "class string")
    assert names(S.call_filter(e, "callee", project), "callee_class") == [("p.C",), ("q.D",)]
    assert names(S.call_filter(e, "callee", project, generated=False), "callee_class") == [("p.C",)]
    assert names(S.call_filter(e, "callee", sets=sets, scope="test"), "callee_class") == [("p.C",)]
    around = S.context(spark.createDataFrame([("p.C",)], "class string"), e, spark.createDataFrame([("p.I", "p.C")], "supertype string, implementor string"), Scratch(spark, "t"), r"p\.C$")
    assert names(around["callers"].orderBy("seq"), "class") == [("p.C",), ("p.B$In",), ("p.A",)]
    assert names(around["supertypes"], "supertype") == [("p.I",)]
    assert S.layer_proposal(spark.createDataFrame([("a.UserController",), ("a.X",)], "class string")) == [{"name": "http", "patterns": ["*Controller"]}, {"name": "domain", "patterns": ["*"]}]
    assert S.layer_proposal(project.limit(0)) == [{"name": "domain", "patterns": ["*"]}]


def test_dead_filters(spark):
    rows = [("CLASS", "p.A", None, "NO_REFERENCES"), ("METHOD", "p.B", "m", "NO_REFERENCES"), ("METHOD", "p.B", "n", "TEST_ONLY"), ("CLASS", "p.FKt", None, "NO_REFERENCES"), ("CLASS", "p.G", None, "NO_REFERENCES")]
    dead = spark.createDataFrame(rows, "kind string, class string, method string, reason string")
    notes = spark.createDataFrame([("p.A", None, "x.Entry"), ("p.B", "m", "x.Entry")], "class string, method string, annotation string")
    at = lambda **k: [(c, m) for c, m in names(S.dead_code_filters(dead, **k), "class", "method")]
    assert at() == [("p.A", None), ("p.FKt", None), ("p.G", None), ("p.B", "m"), ("p.B", "n")]
    assert at(notes=notes, entry_annotations=["Entry"]) == [("p.FKt", None), ("p.G", None), ("p.B", "n")]
    assert at(scope="test") == [("p.B", "n")]
    assert at(pattern="B$", methods=spark.createDataFrame([("p.B", "n")], "class string, method string")) == [("p.B", "m")]
    assert ("p.FKt", None) not in at(receivers=spark.createDataFrame([("p.FKt", "r.R")], "class string, receiver string"), entry_receivers=["r.R"])
    assert ("p.G", None) not in at(supers=spark.createDataFrame([("s.S", "p.G")], "supertype string, implementor string"), entry_supertypes=["s.S"])


def test_output(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, n int")
    assert json.loads(O.as_json(df).split("\n")[1]) == [{"k": "a", "n": 1}, {"k": "b"}]
    assert json.loads(O.as_json(df.limit(0), ["try"]).split("\n")[1]) == {"results": [], "hints": ["try"]}
    assert O.as_compact(df).split("\n")[1:3] == ["k=a n=1", "k=b"]
    assert O.as_table(df).split("\n")[:3] == ["k | n", "- | -", "a | 1"]
    page = O.matrix_page(spark.createDataFrame([("a", "b", 2), ("b", "a", 1)], "src string, tgt string, n long"))
    assert page.count("class='cycle'") == 2 and page.count("class='own'") == 2
    assert O.skipped_report(df.limit(0), str(tmp_path / "none")) is None
    assert "2 files" in O.skipped_report(df, str(tmp_path / "some"))


def test_covered(spark):
    rows = [("f", 0, "g", 0, 60), ("f", 5, "g", 5, 52), ("f", 5, "h", 0, 52), ("x", 0, "y", 0, 50)]
    got = D.without_covered(spark.createDataFrame(rows, D.KEPT))
    assert {tuple(r) for r in got.collect()} == {rows[0], rows[2], rows[3]}
