"""Kotlin metadata and fact tables that are kept, on classes compiled here."""

import os
import shutil
import subprocess
import zipfile

import pytest

from sparkloom.sources import bytecode as B, facts as K, kotlin


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def function(name, flags=None, jvm=None, old=None):
    body = b"" if old is None else field(1, old)
    body += field(2, name) + (b"" if flags is None else field(9, flags))
    return body + (b"" if jvm is None else field(100, field(1, jvm)))


def stream(number, functions, records=b""):
    return varint(len(records)) + records + b"".join(field(number, f) for f in functions)


def eight(data):
    return ["\0" + data[:3].decode("latin-1"), data[3:].decode("latin-1")]


def seven(data):
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    bits += "0" * (-len(bits) % 7)
    return ["".join(chr((int(bits[i : i + 7][::-1], 2) + 1) & 0x7F) for i in range(0, len(bits), 7))]


D2 = ["plain", "fast", "hidden", "LX$Y;"]
INLINE = 6 | 1 << 10


@pytest.mark.parametrize("coded", [eight, seven])
def test_functions(coded):
    records = field(1, field(1, 3)) + field(1, field(3, 2)) + field(1, field(6, b"abcd") + field(4, varint(1) + varint(3))) + field(1, field(2, 0)) + field(1, field(6, b"a-b") + field(5, varint(45) + varint(95)))
    names = [function(0), function(1, INLINE), function(0, 6, 2), function(0, old=6 | 1 << 12), function(3), function(4, INLINE), function(5), function(6)]
    want = [("plain", False), ("fast", True), ("hidden", False), ("plain", True), ("X.Y", False), ("bc", True), ("a_b", False)]
    assert kotlin.functions(1, coded(stream(9, names, records)), D2) == want
    assert kotlin.functions(2, coded(stream(3, names[:2])), D2) == [("plain", False), ("fast", True)]
    assert kotlin.functions(3, coded(stream(9, names)), D2) is None


def test_functions_unreadable():
    assert kotlin.functions(1, [], []) is None
    assert kotlin.functions(1, ["\0"], []) is None
    assert kotlin.functions(1, eight(stream(9, [function(7)])), D2) is None
    assert kotlin.functions(1, eight(stream(9, [function(0)])[:-1]), D2) is None
    assert kotlin.functions(1, eight(stream(9, [])), D2) == []


def java(text):
    return "{" + ", ".join('"' + "".join(f"\\{ord(c):03o}" for c in s) + '"' for s in text) + "}"


@pytest.fixture(scope="module")
def compiled(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no compiler")
    root = tmp_path_factory.mktemp("kt")
    own = java(eight(stream(9, [function(0), function(1, INLINE)])))
    file = java(seven(stream(3, [function(1, INLINE)])))
    d2 = '{"plain", "fast"}'
    sources = {
        "kotlin/Metadata.java": "package kotlin; import java.lang.annotation.*; @Retention(RetentionPolicy.RUNTIME) public @interface Metadata { int k() default 1; int[] mv() default {}; String[] d1() default {}; String[] d2() default {}; }",
        "p/Own.java": f"package p; @Deprecated @kotlin.Metadata(k = 1, mv = {{2, 0}}, d1 = {own}, d2 = {d2}) public class Own implements java.util.function.Supplier<String> {{ static int n = 1; public void plain() {{}} public void fast() {{}} public String get() {{ return null; }} public int size() {{ return 0; }} }}",
        "p/FileKt.java": f"package p; @kotlin.Metadata(k = 2, d1 = {file}, d2 = {d2}) public class FileKt {{ public static void fast() {{}} public static void other() {{}} }}",
        "p/Plain.java": "package p; public class Plain { public void some() {} }",
    }
    for name, text in sources.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    subprocess.run(["javac", "-d", str(root / "out"), *(str(root / n) for n in sources)], check=True)
    return root / "out"


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_inline_and_delegated(spark, compiled):
    facts = B.read_classes(spark, [str(compiled)])
    assert pairs(B.errors(facts)) == []
    assert pairs(B.inline_methods(facts)) == [("p.FileKt", "fast"), ("p.Own", "fast")]
    assert pairs(B.delegated_methods(facts)) == [("p.Own", "get"), ("p.Own", "size")]


def test_refresh(spark, compiled, tmp_path):
    src, store = tmp_path / "src", str(tmp_path / "store")
    shutil.copytree(compiled, src)
    with zipfile.ZipFile(src / "a{1}.jar", "w") as z:
        z.write(compiled / "p" / "Plain.class", "q/Plain.class")
    names = lambda df: sorted(r.path.split("/src/")[1] for r in df.filter("record = 'class'").collect())
    go = lambda **kw: K.refresh(spark, {"prod": [str(src)]}, store, **kw)
    all_ = ["a{1}.jar!/q/Plain.class", "kotlin/Metadata.class", "p/FileKt.class", "p/Own.class", "p/Plain.class"]
    assert names(go()) == all_
    first = K.manifest(spark, store).collect()
    assert names(go()) == all_ and K.manifest(spark, store).collect() == first
    # one file goes, one is new under an odd name, one changes though its length stays
    (src / "p" / "Own.class").unlink()
    shutil.copy(compiled / "p" / "Own.class", src / "p" / "O[w]n 2.class")
    os.utime(src / "p" / "Plain.class", (10**9, 10**9))
    after = ["a{1}.jar!/q/Plain.class", "kotlin/Metadata.class", "p/FileKt.class", "p/O[w]n 2.class", "p/Plain.class"]
    assert names(go()) == after
    assert len({r.part for r in K.manifest(spark, store).collect()}) == 2
    # a file that only goes; then too many parts become one
    (src / "p" / "FileKt.class").unlink()
    assert names(go(most_parts=1)) == [n for n in after if "FileKt" not in n]
    assert len({r.part for r in K.manifest(spark, store).collect()}) == 1
    assert names(K.refresh(spark, {}, store)) == []


def test_jar_of():
    jars = ["/h/.m2/org/acme/core/1.2/core-1.2.jar", "/g/files-2.1/org.acme/util/3/ab/util-3.jar"]
    assert K.jar_of(jars, "org.acme:core") == jars[0]
    assert K.jar_of(jars, "org.acme:util") == jars[1]
    assert K.jar_of(jars, "libs/x.jar") == "libs/x.jar"
    with pytest.raises(ValueError):
        K.jar_of(jars, "org.acme:cor")
