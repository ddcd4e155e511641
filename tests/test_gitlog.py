import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import gitlog as G

LOG = """junk before
--a1--2024-01-02--Ann Lee
3\t1\tsrc/a.kt
-\t-\timg.png
0\t0\told.kt => new.kt

1\t1\tmod/{x => y}/f.kt
1\t1\tmod/{ => z}/f.kt
1\t1\tmod/{z => }/f.kt
5\t5\tbuild/out.txt
2\t2\tbuild-tools/t.kt
4\t4\tmodule/build/x

--b2--2024-02-03--Bo
--c3--2024-03-04--Cy
9\t9\ttarget/only
"""


def test_parse(spark):
    rows = G.parse(spark.createDataFrame([(LOG,), ("",)], "log string")).orderBy("commit_seq", "pos").collect()
    assert {r.hash for r in rows} == {"a1"} and {r.author for r in rows} == {"Ann Lee"} and {str(r.date) for r in rows} == {"2024-01-02"}
    assert [(r.path, r.added, r.deleted) for r in rows] == [("src/a.kt", 3, 1), ("img.png", 0, 0), ("new.kt", 0, 0), ("mod/y/f.kt", 1, 1), ("mod/z/f.kt", 1, 1), ("mod/f.kt", 1, 1), ("build-tools/t.kt", 2, 2), ("module/build/x", 4, 4)]


def test_line_ends_and_renames(spark):
    """Carriage returns are no part of a path; the first brace is the rename's, and only up to its closing one."""
    crlf = spark.createDataFrame([(LOG.replace("\n", "\r\n"),)], "log string")
    assert [r.path for r in G.parse(crlf).orderBy("pos").collect()][:3] == ["src/a.kt", "img.png", "new.kt"]
    cases = {"a/{b => c}/{d}/e": "a/c/{d}/e", "a/{b => c}/d": "a/c/d", "{ => x}/f": "x/f", "{x => }/f": "f", "a => b => c": "c", "a/b.kt": "a/b.kt", "a/{b}/c": "a/{b}/c", " => ": " => ", "a/{b/c => d}.kt": "a/d/.kt"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert [(r.raw, r.got) for r in df.select("raw", "want", G.resolve_rename(F.col("raw")).alias("got")).filter("want <> got").collect()] == []


def test_odd_logs(spark):
    logs = ["", "no header", "--h1--2024-01-02--A", "--h1--2024-01-02--A\n\n--h2--2024-01-03--B\n1\t2\tx\n", "--h1--bad--A\n1\t2\tx", "--h3--2024-01-02--A -- B\n1\t2\ty\n1 2 z\n1\t2\n", None]
    rows = G.parse(spark.createDataFrame([(x,) for x in logs], "log string")).collect()
    assert sorted((r.hash, r.author, r.path) for r in rows) == [("h2", "B", "x"), ("h3", "A -- B", "y")]


def test_run_git(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-c", "user.name=Ann", "-c", "user.email=a@b.c", "-c", "init.defaultBranch=main", *a], cwd=tmp_path, check=True, capture_output=True)
    git("init")
    (tmp_path / "a.kt").write_text("one\ntwo\nthree\n" * 9)
    git("add", ".")
    git("commit", "-m", "first")
    git("branch", "base")
    git("mv", "a.kt", "b.kt")
    git("commit", "-am", "second")
    (tmp_path / "c.bin").write_bytes(bytes(range(256)))
    git("add", ".")
    git("commit", "-m", "third")
    path = tmp_path / "log.txt"
    path.write_text(G.run_git_log(str(tmp_path)))
    rows = G.read_log(spark, str(path)).orderBy("commit_seq").collect()
    assert {(r.path, r.added, r.deleted) for r in rows} == {("c.bin", 0, 0), ("b.kt", 0, 0), ("a.kt", 27, 0)} and {r.author for r in rows} == {"Ann"}
    assert "b.kt" in G.run_git_log(str(tmp_path), follow_renames=False) and G.run_git_log(str(tmp_path), after="2099-01-01").strip() == ""
    assert sorted(G.run_git_diff(str(tmp_path), "base")) in (["b.kt", "c.bin"], ["a.kt", "b.kt", "c.bin"])
    with pytest.raises(RuntimeError):
        G.run_git_diff(str(tmp_path), "nowhere")


def big_log(n, ends="\n"):
    return "junk\n" + "".join(f"--h{i}--2024-01-{i % 28 + 1:02}--Ann é{ends}" + "".join(f"{j}\t1\tsrc/{i}_{j}.kt{ends}" for j in range(i % 7)) + ends for i in range(n))


@pytest.mark.parametrize("split", [1, 7, 97, 1000, 1 << 20])
def test_ranges_give_every_commit_once(tmp_path, split):
    from sparkloom.sources import gitsource as S

    path = tmp_path / "log"
    path.write_bytes(big_log(60).encode())
    size = path.stat().st_size
    got = [(r["at"], r["commit"]) for a in range(0, size, split) for b in S.commits(S.Range(str(path), a, min(size, a + split))) for r in b.to_pylist()]
    assert [c.split("--")[1] for _, c in got] == [f"h{i}" for i in range(60)]
    assert "".join(c for _, c in got) == big_log(60).removeprefix("junk\n") and [a for a, _ in got] == sorted(a for a, _ in got)


def test_log_is_read_by_many_tasks(spark, tmp_path):
    for name, ends in (("a.txt", "\n"), ("b.txt", "\r\n")):
        (tmp_path / name).write_text(big_log(200, ends), newline="")
    rows = G.read_log(spark, str(tmp_path), 512)
    assert rows.rdd.getNumPartitions() > 20
    whole = G.parse(spark.read.text(str(tmp_path), wholetext=True), "value")
    key = ("hash", "date", "author", "path", "added", "deleted")
    assert sorted(map(str, rows.select(*key).collect())) == sorted(map(str, whole.select(*key).collect())) and rows.count() > 1000
    # the order of commits is that of the log
    first = G.read_log(spark, str(tmp_path / "a.txt"), 300).select("commit_seq", "hash").distinct().orderBy("commit_seq").collect()
    assert [r.hash for r in first] == [f"h{i}" for i in range(200) if i % 7]
    (tmp_path / "empty").mkdir()
    assert G.read_log(spark, str(tmp_path / "empty")).count() == 0


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    from sparkloom.sources import gitsource as S

    S.register(spark)
    log, out, state = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "state")
    text = big_log(30)
    cut = text.index("--h17--") + 20  # the header of h17 is there, its changes are not

    def run(final):
        rows = G.parse_commits(spark.readStream.format("commitlog").option("splitBytes", 200).option("final", final).load(str(log)))
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return [r.path for r in spark.read.parquet(out).orderBy("commit_seq", "pos").collect()]

    want = [f"src/{i}_{j}.kt" for i in range(30) for j in range(i % 7)]
    log.write_text(text[:cut])
    assert run("false") == [w for w in want if int(w[4:].split("_")[0]) < 17]
    log.write_text(text)
    assert run("false") == [w for w in want if int(w[4:].split("_")[0]) < 29]
    assert run("true") == want
