"""Class-file reader and its views on classes compiled here; where there is no compiler, on a JAR at hand."""

import glob
import os
import shutil
import subprocess
import zipfile

import pyspark
import pytest

from sparkloom.sources import bytecode as B, classfile as C

SOURCES = {
    "a/Shape.java": "package a; public interface Shape { double area(); }",
    "a/Box.java": """package a;
import b.Store;
import java.lang.annotation.*;
@Deprecated
public class Box implements Shape {
    @Retention(RetentionPolicy.RUNTIME) @Repeatable(Tags.class) @interface Tag { String value(); int[] n() default {}; }
    @Retention(RetentionPolicy.RUNTIME) @interface Tags { Tag[] value(); }
    private int width; long[][] grid; static final String HELLO = "hello";
    public int getWidth() { return width; }
    @Tag("x") @Tag(value = "y", n = {1, 2}) public double area() { return Store.load(this) + Store.total; }
    public Runnable later(String s, int[] k) { return () -> System.out.println("late " + s + HELLO); }
    public Object kind() { return b.Store.class; }
    static int pick(int i) { switch (i) { case 1: return 5; case 2: return 7; case 900: return 1; default: return i; } }
    static int near(int i) { switch (i) { case 1: return 5; case 2: return 7; case 3: return 1; default: return i; } }
}
""",
    "b/Store.java": """package b;
public abstract class Store { public static int total; public static double load(Object o) { return o instanceof a.Box ? new double[2][3].length : 1; } }
""",
    "b/Pair.java": "package b; public record Pair(int x, String y) {}",
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    root = tmp_path_factory.mktemp("java")
    for name, text in SOURCES.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["javac", "-g", "-d", str(root / "out"), *(str(root / n) for n in SOURCES)], check=True)
    (root / "out" / "bad.class").write_bytes(b"nothing")
    data = bytearray((root / "out" / "b" / "Store.class").read_bytes())
    data[6:8] = (120).to_bytes(2, "big")
    (root / "out" / "new.class").write_bytes(data)
    with zipfile.ZipFile(root / "x.jar", "w") as z:
        z.write(root / "out" / "b" / "Store.class", "b/Store.class")
    return B.read_classes(spark, [str(root / "out")]).cache(), str(root / "x.jar")


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_views(facts):
    f, _ = facts
    assert {r.reason for r in B.errors(f).collect()} == {"no class file", "class file version 120 (Java 76)"}
    assert ("a.Box", "Box.java", "a/Box.java", True) in rows(B.classes(f), "class", "source_file", "source_path", "user_defined")
    calls = rows(B.call_edges(f), "caller_class", "caller_method", "callee_class", "callee_method")
    assert {("a.Box", "area", "b.Store", "load"), ("a.Box", "area", "b.Store", "<field:total>"), ("a.Box", "kind", "b.Store", "<class-literal>")} <= calls
    assert any(c[:3] == ("a.Box", "later", "a.Box") and c[3].startswith("lambda$") for c in calls)
    assert not any(c[3] == "<field:width>" for c in calls)
    assert rows(B.supertypes(f), "supertype", "implementor") == {("a.Shape", "a.Box"), ("java.lang.Record", "b.Pair"), ("java.lang.annotation.Annotation", "a.Box$Tag"), ("java.lang.annotation.Annotation", "a.Box$Tags")}
    kinds = dict(rows(B.class_kinds(f), "class", "kind"))
    assert (kinds["a.Shape"], kinds["a.Box"], kinds["b.Store"], kinds["b.Pair"]) == ("INTERFACE", "CONCRETE", "ABSTRACT", "RECORD")
    assert dict(rows(B.class_kinds(f, ["java.lang.Deprecated"]), "class", "kind"))["a.Box"] == "ANNOTATED_MODEL"
    assert rows(B.package_deps(f), "src_class", "tgt_class") == {("a.Box", "b.Store"), ("b.Store", "a.Box")}
    assert ("a.Box", "java.lang.Object") in rows(B.package_deps(f, external=True), "src_class", "tgt_class")
    assert rows(B.fields(f).filter("class = 'a.Box'"), "field", "type") == {("width", "int"), ("grid", "long[][]"), ("HELLO", "String")}
    assert rows(B.field_accessors(f), "class", "method") == {("a.Box", "getWidth")}
    assert {s for _, s, k in rows(B.symbols(f), "class", "symbol", "kind") if _ == "a.Box" and k == "METHOD"} == {"area", "later", "kind", "pick", "near"}
    notes = [(r["class"], r.method, r.annotation, dict(r.params or {})) for r in B.annotations(f).filter("class = 'a.Box'").collect()]
    assert sorted(notes, key=str) == sorted([("a.Box", None, "java.lang.Deprecated", {}), ("a.Box", "area", "a.Box$Tag", {"value": "x"}), ("a.Box", "area", "a.Box$Tag", {"value": "y", "n": "[1, 2]"})], key=str)
    assert rows(B.annotated(B.annotations(f), "tag$", methods=True).selectExpr("class", "array_join(methods, ',') m"), "class", "m") == {("a.Box", "area")}
    assert rows(B.declared_methods(f).filter("class = 'a.Box' and method = 'area'"), "line") == {(10,)}
    detail = B.class_details(f, "box$").collect()[0]
    assert "later(String, int[]): Runnable" in detail.methods and detail.interfaces == ["a.Shape"] and detail.annotations == ["java.lang.Deprecated"]


def test_usages(facts):
    f, _ = facts
    assert rows(B.find_usages(f, owner="b.store"), "caller_method", "target_name", "kind") == {("area", "load", "METHOD_CALL"), ("area", "total", "FIELD_ACCESS")}
    assert rows(B.find_usages(f, owner="Store", field="total"), "target_name") == {("total",)}
    assert rows(B.find_usages(f, type=r"a\.Box$"), "caller_class", "caller_method", "target_name", "kind") >= {("b.Store", "load", "instanceof", "TYPE_REFERENCE")}
    assert rows(B.find_usages(f, owner="Store", outside="a"), "caller_class") == set()
    with pytest.raises(ValueError):
        B.find_usages(f, method="x")


def test_jar(spark, facts):
    found = B.read_jars(spark, [facts[1]])
    assert rows(B.classes(found), "class") == {("b.Store",)}
    assert found.first().path.endswith("x.jar!/b/Store.class")


def test_every_class_of_a_jar():
    """Every class of JARs at hand can be read, and what follows the code is still in step."""
    jars = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize)[40:60]
    n = 0
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            for name in z.namelist():
                if name.endswith(".class") and "module-info" not in name and "META-INF" not in name:
                    got = C.parse(z.read(name))
                    assert [r["class"].replace(".", "/") for r in got if r["record"] == "class"] == [name[:-6]]
                    n += 1
    assert n > 50


def test_damaged_entry(spark, tmp_path):
    """One damaged entry is a row of errors; the rest of the JAR, and other JARs, are read."""
    jar = sorted(glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "*.jar")), key=os.path.getsize)
    good = next(j for j in jar if len([e for e in zipfile.ZipFile(j).namelist() if e.endswith(".class")]) > 2)
    bad = tmp_path / "bad.jar"
    shutil.copy(good, bad)
    first = next(e for e in zipfile.ZipFile(bad).infolist() if e.filename.endswith(".class") and e.file_size > 200)
    data = bytearray(bad.read_bytes())
    at = first.header_offset + 30 + len(first.filename)
    data[at + 20 : at + 60] = b"\xff" * 40
    bad.write_bytes(data)
    (tmp_path / "no.jar").write_bytes(b"nothing")
    facts = B.read_jars(spark, [str(tmp_path)])
    assert len({r.path for r in B.errors(facts).collect()}) == 2 and B.classes(facts).count() >= 1


def test_usages_read_no_more_than_their_rows(facts):
    f, _ = facts
    for asked in ({"owner": "Store"}, {"owner": "Store", "field": "total"}, {"owner": "store", "method": "load"}, {"type": r"a\.Box$"}, {"owner": "Store", "type": "Box", "method": "load"}):
        few = B.usage_facts(f, **asked)
        assert few.columns == ["record", "class", "member", "owner", "name", "desc", "value"]
        assert rows(B.find_usages(few, **asked), *B.USE) == rows(B.find_usages(f, **asked), *B.USE)
        assert few.filter("record = 'use'").count() < f.filter("record = 'use'").count()
