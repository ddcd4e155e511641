"""What renames and moves would touch, on classes written here; the diff of two texts line by line."""

import pytest

from sparkloom import tasks
from sparkloom.operators import diffs, renames as R
from sparkloom.sources import assembler as S, bytecode as B
from sparkloom.util import Scratch


def facts(spark, *classes):
    rows = [(f"{k}.class", bytearray(c.bytes())) for k, c in enumerate(classes)]
    return B.parse_files(spark.createDataFrame(rows, "path string, content binary")).cache()


def targets(spark, *rows, names="class method"):
    return spark.createDataFrame(list(rows), ", ".join(f"{n} string" for n in names.split()))


def got(df, kinds=None):
    rows = [(r.kind, r.site_class, r.site_method, r.line) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return {r for r in rows if kinds is None or r[0] in kinds}


def a_class(name, methods=(), source=None, **more):
    c = S.ClassFile(name, source=source or name.split("/")[-1].split("$")[0] + ".kt", **more)
    for name, desc, code, *rest in methods:
        c.method(name, desc, code, **(rest[0] if rest else {}))
    return c


@pytest.fixture(scope="module")
def shop(spark):
    """Base declares foo; Impl overrides it, Sub inherits it (and has an overload), Low overrides it below Sub, an anonymous class too."""
    own = [("foo", "(I)V", [("line", 3)], {"params": ["n"]}), ("foo$default", "(Lp/Base;IILjava/lang/Object;)V", [("line", 3), ("virtual", "p/Base", "foo", "(I)V")], {"access": S.PUBLIC | S.STATIC | S.SYNTHETIC})]
    calls = [("line", 10), ("virtual", "p/Base", "foo", "(I)V"), ("virtual", "p/Base", "foo", "(I)V"), ("line", 11), ("virtual", "p/Sub", "foo", "(I)V")]
    calls += [("line", 12), ("virtual", "p/Impl", "foo", "(I)V"), ("line", 13), ("virtual", "p/Low", "foo", "(I)V"), ("line", 14), ("virtual", "p/Sub", "foo", "(J)V")]
    calls += [("line", 15), ("static", "p/Base", "foo$default", "(Lp/Base;IILjava/lang/Object;)V"), ("line", 16), ("lambda", "get", "()Ljava/util/function/IntConsumer;", "p/Base", "foo", "(I)V")]
    calls += [("line", 17), ("virtual", "p/Base$Companion", "foo", "(I)V"), ("line", 18), ("virtual", "p/Other", "foo", "(I)V")]
    return facts(
        spark,
        a_class("p/Base", own),
        a_class("p/Base$Companion", [("foo", "(I)V", [("line", 30)])]),
        a_class("p/Impl", [("foo", "(I)V", [("line", 5)]), ("foo", "(Ljava/lang/Object;)V", [("line", 1)], {"access": S.PUBLIC | S.BRIDGE | S.SYNTHETIC})], parent="p/Base"),
        a_class("p/Sub", [("foo", "(J)V", [("line", 6)])], parent="p/Base"),
        a_class("p/Low", [("foo", "(I)V", [("line", 7)])], parent="p/Sub"),
        a_class("p/Use$1", [("foo", "(I)V", [("line", 8)])], parent="p/Base"),
        a_class("p/Other", [("foo", "(I)V", [("line", 9)])]),
        a_class("p/Use", [("run", "()V", calls), ("lambda$run$0", "()V", [("line", 20), ("virtual", "p/Base", "foo", "(I)V")], {"access": S.STATIC | S.SYNTHETIC})]),
    )


def test_method(spark, shop):
    found = R.rename_method(shop, targets(spark, ("p.Base", "foo"), ("p.Base", "foo"), (None, "foo"), ("p.Base", None)), Scratch(spark, "t"))
    assert got(found, {"DECLARATION"}) == {("DECLARATION", c, "foo", n) for c, n in (("p.Base", 3), ("p.Base$Companion", 30), ("p.Impl", 5), ("p.Sub", 6))}
    assert got(found, {"CALL"}) == {("CALL", "p.Use", "run", n) for n in (10, 11, 15, 17)} | {("CALL", "p.Use", "lambda$run$0", 20)}
    assert got(found, {"REFERENCE"}) == {("REFERENCE", "p.Use", "run", 16)}
    assert {r.source_path for r in found.filter("kind = 'CALL'").collect()} == {"p/Use.kt"}


def test_methods_of_several_targets_and_outside_ones(spark, shop):
    found = R.rename_method(shop, targets(spark, ("p.Sub", "foo"), ("p.Other", "foo"), ("p.None", "foo"), ("p.Base", "none")), Scratch(spark, "t"))
    assert {(r["class"], r.kind, r.line) for r in found.collect() if r.site_class == "p.Use"} == {("p.Sub", "CALL", 14), ("p.Other", "CALL", 18)}
    user = facts(spark, a_class("q/A", parent="lib/Type"), a_class("q/B", [("run", "()V", [("line", 1), ("virtual", "q/A", "go", "()V"), ("line", 2), ("virtual", "lib/Type", "go", "()V")])]))
    found = R.rename_method(user, targets(spark, ("lib.Type", "go")), Scratch(spark, "t"))
    assert got(found) == {("CALL", "q.B", "run", 1), ("CALL", "q.B", "run", 2)}
    nothing = user.filter("false")
    assert R.rename_method(nothing, targets(spark, ("lib.Type", "go")), Scratch(spark, "t")).count() == 0
    assert R.rename_method(user, targets(spark), Scratch(spark, "t")).count() == 0


def test_parameter(spark):
    code = [("line", 4), ("load", 3), ("virtual", "p/B", "take", "(J)V"), ("line", 5), ("store", 3), ("line", 6), ("load", 1), ("virtual", "p/B", "other", "(J)V"), ("line", 7), ("load", 3), ("virtual", "p/B", "other", "(J)V")]
    a = a_class("p/A", [("run", "(JI)V", code, {"params": ["size", "rate"]}), ("run", "(J)V", [("line", 9)], {"params": ["size"]}), ("<init>", "(I)V", [("line", 1)], {"params": ["rate"]})])
    a.field("rate", "I")
    b = a_class("p/B", [("take", "(J)V", [("line", 20)], {"params": ["rate"]}), ("other", "(J)V", [("line", 21)], {"params": ["size"]})])
    c = a_class("p/C", [("go", "()V", [("line", 30), ("virtual", "p/A", "run", "(JI)V"), ("line", 31), ("virtual", "p/A", "run", "(J)V"), ("line", 32), ("special", "p/A", "<init>", "(I)V")])])
    f = facts(spark, a, b, c)
    ask = lambda method, param: got(R.rename_parameter(f, targets(spark, ("p.A", method, param), names="class method param"), Scratch(spark, "t")))
    assert ask("run", "rate") == {("PARAMETER", "p.A", "run", 4), ("READ", "p.A", "run", 4), ("WRITE", "p.A", "run", 5), ("READ", "p.A", "run", 7), ("CALL", "p.C", "go", 30), ("CASCADE", "p.B", "take", 20)}
    # both overloads have a size; only the first reads it, and hands it on
    assert ask("run", "size") == {("PARAMETER", "p.A", "run", 4), ("PARAMETER", "p.A", "run", 9), ("READ", "p.A", "run", 6), ("CALL", "p.C", "go", 30), ("CALL", "p.C", "go", 31), ("CASCADE", "p.B", "other", 21)}
    assert ask("<init>", "rate") == {("PARAMETER", "p.A", "<init>", 1), ("CALL", "p.C", "go", 32), ("PROPERTY", "p.A", "<init>", None)}
    assert ask("run", "none") == set()


def test_property(spark):
    own = [
        ("<init>", "(Z)V", [("line", 1), ("putfield", "p/A", "isOpen", "Z")], {"params": ["isOpen"]}),
        ("isOpen", "()Z", [("line", 1), ("getfield", "p/A", "isOpen", "Z")]),
        ("copy", "(Z)Lp/A;", [("getfield", "p/A", "isOpen", "Z")], {"params": ["isOpen"]}),
        ("toString", "()Ljava/lang/String;", [("getfield", "p/A", "isOpen", "Z")]),
        ("hashCode", "()I", [("line", 7), ("getfield", "p/A", "isOpen", "Z")]),
    ]
    a = a_class("p/A", own)
    a.field("isOpen", "Z")
    code = [("line", 20), ("virtual", "p/A", "isOpen", "()Z"), ("line", 21), ("virtual", "p/A", "setOpen", "(Z)V"), ("line", 22), ("virtual", "p/A", "copy", "(Z)Lp/A;"), ("line", 23), ("special", "p/A", "<init>", "(Z)V")]
    code += [("line", 24), ("static", "p/A", "copy$default", "(Lp/A;ZILjava/lang/Object;)Lp/A;"), ("line", 25), ("virtual", "p/A", "getOpen", "()Z"), ("line", 26), ("lambda", "get", "()Lx/F;", "p/A", "isOpen", "()Z"), ("line", 27), ("virtual", "p/B", "isOpen", "()Z")]
    f = facts(spark, a, a_class("p/U", [("main", "()V", code)]))
    found = got(R.rename_property(f, targets(spark, ("p.A", "isOpen"), ("p.A", None), names="class property")))
    used = {("READ", 20), ("WRITE", 21), ("ARGUMENT", 22), ("ARGUMENT", 23), ("ARGUMENT", 24), ("READ", 26)}
    assert found == {("FIELD", "p.A", None, None), ("PARAMETER", "p.A", "<init>", 1), ("WRITE", "p.A", "<init>", 1), ("READ", "p.A", "hashCode", 7)} | {(k, "p.U", "main", n) for k, n in used}


def test_move(spark):
    user = [("run", "()V", [("new", "p/One"), ("static", "p/ToolsKt", "go", "()V")])]
    f = facts(spark, a_class("p/ToolsKt", source="Tools.kt"), a_class("p/One", source="Tools.kt"), a_class("p/One$In", source="Tools.kt"), a_class("p/Two"), a_class("p/Use", user), a_class("q/Tools", source="Tools.kt"))
    ask = lambda *row: {(r.kind, r.site_class, r.new_path) for r in R.move_class(f, targets(spark, row, names="class new_class")).collect()}
    assert ask("p.Two", "q.r.Second") == {("MOVED", "p.Two", "q/r/Second.kt")}
    assert ask("p.One", "q.Uno") == {("MOVED", "p.One", "q/Tools.kt"), ("MOVED", "p.One$In", "q/Tools.kt"), ("REFERENCE", "p.Use", None)}
    assert ask("p.ToolsKt", "q.HelpKt") == {("MOVED", c, "q/Help.kt") for c in ("p.ToolsKt", "p.One", "p.One$In")} | {("REFERENCE", "p.Use", None)}
    assert ask("p.Missing", "q.X") == set()


def test_move_deals_out_little(spark):
    """References into packages that nothing moves in are left out, and few shuffles are planned, 44 before."""
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    f = facts(spark, a_class("p/One"), a_class("p/Two", [("run", "()V", [("new", "p/One"), ("new", "q/Other")])]), a_class("q/Other"))
    spark.conf.set(key, "-1")
    try:
        found = R.move_class(f, targets(spark, ("p.One", "r.Uno"), names="class new_class"))
        shuffles = found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(key, before)
    assert {(r.kind, r.site_class) for r in found.collect()} == {("MOVED", "p.One"), ("REFERENCE", "p.Two")}
    assert shuffles <= 10


def test_wide_slots_and_statics():
    from sparkloom.sources import classfile as C

    assert C.parameter_slots("(J[D[[Lp/A;DI)V", False) == {1: 0, 3: 1, 4: 2, 5: 3, 7: 4}
    assert C.parameter_slots("(IJ)V", True) == {0: 0, 1: 1}
    assert list(C.instructions(bytes([0xC4, 0x15, 1, 0, 0xC4, 0x84, 0, 2, 0, 1, 0x1B, 0x84, 3, 1, 0xB1]))) == [(0x15, 256, 0), (0x84, 2, 4), (0x1B, 0, 10), (0x84, 3, 11), (0xB1, 0, 14)]


def test_tasks(spark, shop):
    i = tasks.Inputs(spark, facts=shop)
    ask = lambda task, **given: tasks.run(i, task, preview=None, **given)
    assert got(ask("rename-method", target_class="p.Other", method="foo", new_name="bar")) == {("DECLARATION", "p.Other", "foo", 9), ("CALL", "p.Use", "run", 18)}
    assert ask("rename-param", target_class="p.Base", method="foo", param="n").filter("kind = 'PARAMETER'").count() == 1
    assert {r[::3] for r in got(ask("rename-property", target_class="p.Base", property="n"))} == {("ARGUMENT", n) for n in (10, 15, 20)}
    assert ask("move-class", from_="p.Other", to="q.Other").filter("kind = 'MOVED'").count() == 1
    for bad in ({"target_class": "p.Other", "preview": None}, {"target_class": "p.Other", "method": "foo"}):
        with pytest.raises(ValueError):
            tasks.run(i, "rename-method", **bad)


def plain_diff(before, after):
    import re

    a, b = ([] if t is None else re.split("\r\n|\n|\r", t) for t in (before, after))
    out = []
    for k in range(max(len(a), len(b))):
        x, y = (t[k] if k < len(t) else None for t in (a, b))
        if x != y:
            out += [(k + 1, s, t) for s, t in (("-", x), ("+", y)) if t is not None]
    return out


def test_diff(spark):
    texts = [None, "", "a", "a\nb", "a\r\nb\rc\n", "b\nb\n\n", "x\ny\nc"]
    rows = [(i * 10 + j, a, b) for i, a in enumerate(texts) for j, b in enumerate(texts)]
    got = diffs.diff_lines(spark.createDataFrame(rows, "id int, before string, after string"), ["id"]).collect()
    assert sorted((r.id, r.line, r.sign, r.text) for r in got) == sorted((k, *d) for k, a, b in rows for d in plain_diff(a, b))
