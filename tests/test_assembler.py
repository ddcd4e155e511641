"""Class files written here are what the JDK's own reader sees, and what the parser reads back; usages by their cases."""

import io
import shutil
import subprocess
import zipfile

import pytest

from sparkloom.sources import assembler as S, bytecode as B, classfile as C


def a_class(name, calls=(), source=None, method="run", **more):
    c = S.ClassFile(name, source=source, **more)
    c.method("<init>", "()V", [("special", "java/lang/Object", "<init>", "()V")])
    c.method(method, "()V", list(calls))
    return c


def everything():
    notes = [S.Note(("Lx/Y;", {"v": ["a", "b"], "n": 3, "b": True, "e": S.Enum(("Lx/E;", "ONE")), "c": S.Type("Lx/Z;"), "m": S.Note(("Lx/Q;", {"k": "v"}))}))]
    c = S.ClassFile("p/A", faces=["java/io/Serializable"], source="A.kt", notes=[*notes, S.kotlin_metadata([("run", True), ("go", False)])])
    c.field("f", "[[Ljava/lang/String;")
    code = [("line", 5), ("virtual", "p/B", "go", "()V"), ("label", "top"), ("getstatic", "p/B", "x", "I"), ("switch", 1, ["top", "end"], "end"), ("text", "hé\0𝄞"), ("classof", "p/C")]
    code += [("text", f"t{i}") for i in range(300)]  # constants past 255 need the wide form
    code += [("lambda", "apply", "()Ljava/util/function/Function;", "p/D", "run", "()V"), ("jump", 0xA7, "top"), ("label", "end"), ("line", 9), ("checkcast", "p/E"), ("interface", "p/F", "m", "()I")]
    c.method("run", "(ILjava/lang/String;)V", code, throws=["java/io/IOException"])
    c.method("abs", "()V", access=S.PUBLIC | S.ABSTRACT)
    return c.bytes()


@pytest.mark.skipif(shutil.which("javap") is None, reason="no JDK")
def test_the_jdk_reads_it(tmp_path):
    (tmp_path / "A.class").write_bytes(everything())
    out = subprocess.run(["javap", "-v", "-p", str(tmp_path / "A.class")], capture_output=True, text=True, timeout=60)
    assert out.returncode == 0 and "rror" not in out.stderr
    for s in ("public void run(int, java.lang.String) throws java.io.IOException", "tableswitch   { // 1 to 2", "default: ", "goto          3", "String t299", "InvokeDynamic #0:apply", 'v=["a","b"]', "line 9:", "invokeinterface"):
        assert s in out.stdout, s


def test_the_parser_reads_it_back():
    rows = C.parse(everything())
    of = lambda record: [r for r in rows if r["record"] == record]
    assert of("class")[0]["value"] == "A.kt" and of("class")[0]["names"] == ["java.io.Serializable"]
    assert of("note")[0]["params"] == {"v": "[a, b]", "n": "3", "b": "true", "e": "E.ONE", "c": "Z", "m": "@Q(k=v)"}
    assert [r["member"] for r in of("inline")] == ["run"]
    assert of("text")[0]["value"] == "hé\0𝄞" and len(of("text")) == 301
    assert {(r["owner"], r["name"]) for r in of("call")} == {("p.B", "go"), ("p.B", "<field:x>"), ("p.C", "<class-literal>"), ("p.D", "run"), ("p.F", "m")}
    assert [(r["member"], r["line"]) for r in of("method")] == [("run", 5), ("abs", None)]


def test_limits():
    c = S.ClassFile("p/Big")
    with pytest.raises(ValueError):
        for i in range(70_000):
            c.text(str(i))
    with pytest.raises(ValueError):
        c.method("m", "()V", [("nothing", 1)])


def test_jar():
    data = S.jar([("p/A.class", b"1" * 999), ("x.txt", b"")])
    assert data == S.jar([("p/A.class", b"1" * 999), ("x.txt", b"")])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.namelist() == ["p/A.class", "x.txt"] and z.read("p/A.class") == b"1" * 999 and z.testzip() is None


D = "(Ljava/lang/String;)V"
CALL = ("virtual", "p/Target", "go", D)


@pytest.fixture(scope="module")
def facts(spark):
    caller = lambda n, *calls, **m: a_class(n, calls, f"{n.rsplit('/', 1)[-1]}.kt", **m)
    declares = S.ClassFile("p/Declares", source="Declares.kt")
    declares.field("held", "Lp/Target;")
    declares.method("takes", "(Lp/Target;I)V", [])
    declares.method("gives", "()[Lp/Target;", [])
    classes = [
        caller("p/Once", CALL, CALL),
        caller("p/Other", ("virtual", "p/Target", "stop", "()V"), ("virtual", "p/Elsewhere", "go", D)),
        caller("p/Fields", ("getfield", "p/Target", "size", "I"), ("putstatic", "p/Target", "all", "I"), ("getfield", "p/Fields", "size", "I")),
        caller("p/Types", ("new", "p/Target"), ("checkcast", "p/Target"), ("instanceof", "p/Target"), ("newarray", "p/Target")),
        caller("p/Access", *(("virtual", "p/Target", n, "()I") for n in ("getSize", "setSize", "isSize", "resize", "getSizes"))),
        caller("p/Lambda", ("lambda", "get", "()Ljava/util/function/Supplier;", "p/Target", "make", "()Lp/Target;")),
        caller("p/inner/In", CALL),
        caller("pq/Near", CALL),
        caller("p/Gen$1", CALL),
        caller("p/Names", CALL, method="access$run"),
        declares,
    ]
    files = spark.createDataFrame([(f"{i}.class", bytearray(c.bytes())) for i, c in enumerate(classes)], "path string, content binary")
    return B.parse_files(files).cache()


def found(facts, *columns, **ask):
    return sorted(tuple(r[c] for c in columns) for r in B.find_usages(facts, **ask).collect())


def test_usages_of_methods(facts):
    hits = found(facts, "caller_class", "target_descriptor", "source_file", owner="^p[.]target$", method="go")
    assert [h[0] for h in hits] == ["p.Gen$1", "p.Names", "p.Once", "p.inner.In", "pq.Near"] and {h[1] for h in hits} == {D}
    assert ("p.Once", D, "Once.kt") in hits  # twice called, once reported
    assert found(facts, "caller_class", owner="Target", method="g") == [] == found(facts, "caller_class", owner="^Target")
    assert ("p.Other", "stop") in found(facts, "caller_class", "target_name", owner="Target")
    assert ("p.Lambda", "make") in found(facts, "caller_class", "target_name", owner="Target")


def test_usages_of_fields(facts):
    hits = found(facts, "caller_class", "target_name", "kind", owner="p[.]Target$", field="size")
    assert hits == [("p.Access", n, "METHOD_CALL") for n in ("getSize", "isSize", "setSize")] + [("p.Fields", "size", "FIELD_ACCESS")]
    assert ("p.Fields", "all", "FIELD_ACCESS") in found(facts, "caller_class", "target_name", "kind", owner="Target$")
    with pytest.raises(ValueError):
        B.find_usages(facts, owner="x", field="a", method="b")
    with pytest.raises(ValueError):
        B.find_usages(facts, method="b")


def test_usages_of_types(facts):
    hits = set(found(facts, "caller_class", "caller_method", "target_name", type="p[.]Target$"))
    assert {("p.Types", "run", n) for n in ("new", "checkcast", "instanceof", "newarray")} <= hits
    assert {("p.Declares", "takes", "takes"), ("p.Declares", "gives", "gives"), ("p.Declares", "<field>", "held")} <= hits
    assert ("p.Once", "run", "go") in hits and ("p.Fields", "run", "size") in hits
    # with a method only its calls stay, and what names the type by itself
    narrow = set(found(facts, "caller_class", "caller_method", "target_name", type="p[.]Target$", method="stop"))
    assert ("p.Other", "run", "stop") in narrow and ("p.Once", "run", "go") not in narrow


def test_usages_by_caller(facts):
    outside = [c for (c,) in found(facts, "caller_class", owner="p[.]Target$", method="go", outside="p")]
    assert outside == ["pq.Near"]
    assert [c for (c,) in found(facts, "caller_class", owner="p[.]Target$", method="go", outside="p.inner")] == ["p.Gen$1", "p.Names", "p.Once", "pq.Near"]
    assert [c for (c,) in found(facts, "caller_class", owner="p[.]Target$", method="go", generated=False)] == ["p.Once", "p.inner.In", "pq.Near"]
