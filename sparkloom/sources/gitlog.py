"""Version-control history: run git, parse its numstat log into file_changes."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Build output, as path prefixes.
BUILD_DIRS = ("build/", "target/", "bin/", ".gradle/", "out/", "node_modules/")


def run_git_log(directory: str, after: str | None = None, follow_renames: bool = True) -> str:
    """`git log` of all branches with numstat; raises if git fails."""
    #: fixed value: the form in which git prints a commit
    cmd = ["git", "log", "--all", "--numstat", "--date=short", "--pretty=format:--%h--%ad--%aN", "-M" if follow_renames else "--no-renames"]
    done = subprocess.run(cmd + ([f"--after={after}"] if after else []), cwd=directory, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git log failed: {done.stderr.strip() or done.stdout.strip()}")
    return done.stdout


def run_git_diff(directory: str, ref: str) -> list[str]:
    """Paths changed since the merge base with ref."""
    done = subprocess.run(["git", "diff", "--name-only", f"{ref}...HEAD"], cwd=directory, capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git diff failed: {done.stderr.strip()}")
    return [x.strip() for x in done.stdout.splitlines() if x.strip()]


def resolve_rename(c):
    """`pre{old => new}suf` and `old => new` give the new path."""
    #: fixed value: the form of a rename inside a path
    brace = r"^(.*?)\{([^}]*) => ([^}]*)\}(.*)$"
    parts = F.array(*(F.regexp_replace(F.regexp_extract(c, brace, i), "^/+|/+$", "") for i in (1, 3, 4)))
    return F.when(c.rlike(brace), F.array_join(F.filter(parts, lambda x: x != ""), "/")).when(c.rlike("^.+ => .+$"), F.regexp_extract(c, r"^.+ => (.+)$", 1)).otherwise(c)


def parse(logs: DataFrame, log: str = "log", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per log text -> (commit_seq, hash, date, author, pos, path, added, deleted).

    Header lines are `--hash--date--author`; other lines count with three tab-separated fields and
    after a header; counts that are no numbers (binary files) are 0. Build output is dropped.
    A log is one string, so its lines are numbered inside the row; headers split it into commits
    by a higher-order fold, without a global window.
    """
    #: fixed value: the form of a commit's first line
    header = r"^--([^-]+)--(\d{4}-\d{2}-\d{2})--(.+)$"
    # commits begin at header lines: cut the text there, then each part is one commit
    parts = F.split(F.concat(F.lit("\n"), F.col(log)), r"\n(?=--[^-\n]+--\d{4}-\d{2}-\d{2}--[^\n])")
    commits = logs.select(*keep, F.posexplode(parts).alias("commit_seq", "part")).withColumn("lines", F.split("part", "\r?\n"))
    head = F.regexp_replace(F.get(F.col("lines"), F.lit(0)), "\r$", "")
    rows = commits.filter(head.rlike(header)).select(
        *keep, F.col("commit_seq").cast("long"), F.regexp_extract(head, header, 1).alias("hash"), F.to_date(F.regexp_extract(head, header, 2)).alias("date"), F.regexp_extract(head, header, 3).alias("author"), F.posexplode("lines").alias("pos", "line")
    )
    f = F.split(F.regexp_replace("line", "\r$", ""), "\t")
    changes = rows.filter((F.col("pos") > 0) & (F.size(f) == 3)).select(*keep, "commit_seq", "hash", "date", "author", "pos", resolve_rename(F.get(f, F.lit(2))).alias("path"), F.coalesce(F.get(f, F.lit(0)).try_cast("int"), F.lit(0)).alias("added"), F.coalesce(F.get(f, F.lit(1)).try_cast("int"), F.lit(0)).alias("deleted"))
    return changes.filter(~_starts(F.col("path"), BUILD_DIRS))


def _starts(c, prefixes):
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def parse_commits(rows: DataFrame) -> DataFrame:
    """The changes of rows (file, at, commit) of the data source `commitlog`, as parse gives them; commit_seq is the place in the log."""
    changes = parse(rows, "commit", ("file", "at"))
    return changes.withColumn("commit_seq", F.col("at")).drop("file", "at")


def read_log(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """The changes of a log, or of a folder of logs, read by ranges of bytes."""
    from sparkloom.sources import gitsource

    gitsource.register(spark)
    reader = spark.read.format("commitlog")
    return parse_commits((reader.option("splitBytes", split_bytes) if split_bytes else reader).load(path))
