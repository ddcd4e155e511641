"""Entries of JARs by ranges: the same facts as whole archives, in several tasks; damage is told by entry."""

from sparkloom.sources import assembler as S, bytecode as B, jars


def a_class(k):
    c = S.ClassFile(f"p/C{k}", source=f"C{k}.kt")
    c.method("run", "()V", [("virtual", f"p/C{k + 1}", "run", "()V"), ("text", "x" * (k % 50))])
    return c.bytes()


def test_ranges_equal_whole_archives(spark, tmp_path):
    for name, packed in (("a", True), ("b", False)):
        (tmp_path / f"{name}.jar").write_bytes(S.jar([*((f"p/C{k}.class", a_class(k)) for k in range(300)), ("META-INF/MANIFEST.MF", b"x")], packed))
    (tmp_path / "empty.jar").write_bytes(S.jar([]))
    rows = jars.entries(spark, [str(tmp_path)], stretch=8 << 10)
    sizes = [len(r.names) for r in rows.collect()]
    assert sum(sizes) == 600 and len(sizes) > 10  # a JAR is the work of several rows
    got, want = (sorted(map(str, B.read_jars(spark, [str(tmp_path)], whole=w).collect())) for w in (False, True))
    assert got == want and len(got) > 1000


def test_damage(spark, tmp_path):
    data = bytearray(S.jar([(f"p/C{k}.class", a_class(k)) for k in range(5)]))
    at = data.index(b"PK\3\4", 1)
    data[at + 60 : at + 64] = b"\xff\xff\xff\xff"  # inside the second entry's content
    (tmp_path / "hurt.jar").write_bytes(bytes(data))
    (tmp_path / "no.jar").write_bytes(b"no archive")
    facts = B.read_jars(spark, [str(tmp_path)]).cache()
    bad = {r.path.rsplit("/", 1)[-1]: r.reason for r in B.errors(facts).collect()}
    assert set(bad) == {"C1.class", "no.jar"}
    assert {r["class"] for r in B.classes(facts).collect()} == {"p.C0", "p.C2", "p.C3", "p.C4"}


def test_written_jars(spark, tmp_path):
    files = spark.createDataFrame([(f"p/C{k}.class", bytearray(a_class(k))) for k in range(40)], "path string, content binary")
    made = jars.write(files, f"file://{tmp_path}/out", 3).collect()
    assert sum(r.entries for r in made) == 40 and len(made) == len(list((tmp_path / "out").glob("*.jar")))
    assert B.classes(B.read_jars(spark, [f"{tmp_path}/out"])).count() == 40
