"""Analyses of change history: file_changes(commit_seq, date, author, path, added, deleted) -> DataFrame.

Every result ends its order with the entity's name, so that ties before a limit are decided alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def top(df: DataFrame, n: int | None, *order) -> DataFrame:
    df = df.orderBy(*order)
    return df if n is None else df.limit(n)


def hotspots(changes: DataFrame, min_revs: int = 1, n: int | None = 50) -> DataFrame:
    out = changes.groupBy("path").agg(F.count(F.lit(1)).alias("revisions"), F.sum(F.col("added").cast("long") + F.col("deleted")).alias("churn"))
    return top(out.filter(F.col("revisions") >= min_revs), n, F.desc("revisions"), "path")


def churn(changes: DataFrame, n: int | None = 50) -> DataFrame:
    out = changes.groupBy("path").agg(F.sum(F.col("added").cast("long")).alias("added"), F.sum(F.col("deleted").cast("long")).alias("deleted"), F.count(F.lit(1)).alias("commits"))
    out = out.withColumn("net", F.col("added") - F.col("deleted"))
    return top(out, n, F.desc(F.col("added") + F.col("deleted")), "path")


def code_age(changes: DataFrame, now: Column, n: int | None = 50) -> DataFrame:
    """Complete calendar months since the last change."""
    out = changes.groupBy("path").agg(F.max("date").alias("last_changed"))
    out = out.withColumn("age_months", F.timestamp_diff("MONTH", F.col("last_changed").cast("timestamp"), now.cast("timestamp")).cast("long"))
    return top(out, n, F.desc("age_months"), "path")


def authors(changes: DataFrame, min_revs: int = 1, n: int | None = 50) -> DataFrame:
    out = changes.groupBy("path").agg(F.countDistinct("author").alias("authors"), F.count(F.lit(1)).alias("revisions"))
    return top(out.filter(F.col("revisions") >= min_revs), n, F.desc("authors"), "path")


def coupling(changes: DataFrame, min_shared: int = 5, min_degree: int = 30, max_changeset: int = 30, n: int | None = 50) -> DataFrame:
    """Pairs that change together. Commits above max_changeset are skipped before pairing, which bounds a commit's pairs."""
    files = changes.select("commit_seq", "path").distinct()
    sizes = files.groupBy("commit_seq").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") <= max_changeset).drop("m")
    used = files.join(sizes, "commit_seq")
    revs = used.groupBy("path").agg(F.count(F.lit(1)).alias("revs"))
    a, b = used.select("commit_seq", F.col("path").alias("entity")), used.select("commit_seq", F.col("path").alias("coupled"))
    pairs = a.join(b, "commit_seq").filter("entity < coupled").groupBy("entity", "coupled").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= min_shared)
    both = pairs.join(revs.select(F.col("path").alias("entity"), F.col("revs").alias("ra")), "entity").join(revs.select(F.col("path").alias("coupled"), F.col("revs").alias("rb")), "coupled")
    out = both.withColumn("avg_revs", F.expr("(ra + rb) div 2")).withColumn("degree", F.expr("shared * 100 div avg_revs")).filter(F.col("degree") >= min_degree)
    return top(out.select("entity", "coupled", "degree", "shared", "avg_revs"), n, F.desc("degree"), "entity", "coupled")


def package_of_file(path: Column) -> Column:
    """Package of a source path below src/{main,test}/{kotlin,java}/; null elsewhere."""
    inner = F.regexp_extract(path, r"^src/(?:main|test)/(?:kotlin|java)/(?:(.*)/)?[^/]*$", 1)
    return F.when(path.rlike(r"^src/(main|test)/(kotlin|java)/"), F.translate(inner, "/", "."))


def volatility(spots: DataFrame, package: Column, n: int | None = None) -> DataFrame:
    """Hotspots by package; files without a package are dropped."""
    out = spots.withColumn("package", package).filter("package is not null").groupBy("package").agg(F.sum("revisions").alias("revisions"), F.sum("churn").alias("churn"), F.count(F.lit(1)).alias("files"))
    out = out.withColumn("avg_revs", F.col("revisions") / F.col("files"))
    return top(out, n, F.desc("revisions"), "package")


def upper_median(df: DataFrame, c: str) -> DataFrame:
    """(k, median): rows, and the middle value, the greater of two: the lower one of the descending order."""
    return df.agg(F.count(F.lit(1)).alias("k"), F.expr(f"percentile_disc(0.5) within group (order by {c} desc)").alias("median"))


def mark_hotspots(spots: DataFrame) -> DataFrame:
    """hot: of five or more files, at least twice the upper median of revisions."""
    m = upper_median(spots, "revisions")  # one row
    return spots.crossJoin(F.broadcast(m)).withColumn("hot", (F.col("k") >= 5) & (F.col("revisions") >= 2 * F.col("median"))).drop("k", "median")


def mark_sizes(files: DataFrame) -> DataFrame:
    """large: of three or more files, at least three times the upper median of lines, if that is above zero."""
    m = upper_median(files, "lines")  # one row
    return files.crossJoin(F.broadcast(m)).withColumn("large", (F.col("k") >= 3) & (F.col("median") > 0) & (F.col("lines") >= 3 * F.col("median"))).drop("k", "median")


def mark_coupling(pairs: DataFrame, high: int = 70) -> DataFrame:
    """strong: a high degree, but for a main file with a test file."""
    side = lambda c, s: F.col(c).startswith(f"src/{s}/")
    tested = side("entity", "main") & side("coupled", "test") | side("entity", "test") & side("coupled", "main")
    return pairs.withColumn("strong", (F.col("degree") >= high) & ~tested)


def sizes(files: DataFrame, over: int = 0, n: int | None = 50) -> DataFrame:
    return top(files.filter(F.col("lines") > over), n, F.desc("lines"), "file")
