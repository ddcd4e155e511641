"""Fact tables that are kept: only new and changed class files and JARs are parsed again.

A folder holds `parts` (facts as Parquet, one part for each refresh that parsed something) and
`manifest` (one table for each refresh: file, modified, length, source_set, part). A file counts as
unchanged while its path, time, length and source set stay; what is gone drops out. Manifests are
numbered and count once Spark has committed them, so a lost job leaves the last one in force. Past
`most_parts` parts the facts in force are written as one.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.sources import bytecode as B

KEY = ("file", "modified", "length", "source_set")
MANIFEST = "file string, modified timestamp, length long, source_set string, part string"


def _listed(spark: SparkSession, folder: str, marker: str = "_SUCCESS") -> list[str]:
    """Names of committed tables below a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    inner = [s.getPath() for s in fs.listStatus(path)]
    return [p.getName() for p in inner if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, marker))]


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Files of the last committed refresh."""
    numbers = [int(n) for n in _listed(spark, f"{folder}/manifest")]
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest/{max(numbers)}") if numbers else spark.createDataFrame([], MANIFEST)


def files(spark: SparkSession, sources: dict[str, list[str]]) -> DataFrame:
    """(file, modified, length, source_set) of class files and JARs below the folders of each source set; contents are not read."""
    out = None
    for name, paths in sources.items():
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.{class,jar}").option("recursiveFileLookup", True).load(paths)
        found = found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), "length", F.lit(name).alias("source_set"))
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], MANIFEST).drop("part") if out is None else out


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The facts in force."""
    now = manifest(spark, folder)
    parts = [r.part for r in now.select("part").distinct().collect()]  # at most most_parts and one
    if not parts:
        return spark.createDataFrame([], f"{B.C.FACT}, source_set string")
    facts = spark.read.option("basePath", f"{folder}/parts").parquet(*(f"{folder}/parts/part={p}" for p in parts))
    keys = now.select(F.col("file").alias("f"), F.col("source_set").alias("s"), F.col("part").alias("p"))
    own = F.substring_index("path", "!/", 1)
    return facts.join(keys, (own == F.col("f")) & (F.col("source_set") == F.col("s")) & (F.col("part") == F.col("p")), "left_semi").drop("part")


def refresh(spark: SparkSession, sources: dict[str, list[str]], folder: str, most_parts: int = 16) -> DataFrame:
    """Bring the table up to date with the sources (source set -> folders); the facts in force."""
    folder = folder.rstrip("/")
    before, now = manifest(spark, folder), files(spark, sources).distinct()
    same = now.join(before, list(KEY))
    fresh = now.join(before, list(KEY), "left_anti")
    part = uuid.uuid4().hex
    # the listing is the driver's in any case, so are the paths to be read
    todo = fresh.select("file", "source_set").collect()
    if not todo and now.count() == before.count():
        return load(spark, folder)
    facts = None
    for name in sorted({r.source_set for r in todo}):
        for suffix, read in ((".class", B.read_classes), (".jar", B.read_jars)):
            paths = [re.sub(r"([\\{}\[\]*?])", r"\\\1", r.file) for r in todo if r.source_set == name and r.file.endswith(suffix)]
            if paths:
                rows = read(spark, paths, name)
                facts = rows if facts is None else facts.union(rows)
    if facts is not None:
        facts.write.parquet(f"{folder}/parts/part={part}")
    after = same.select(*KEY, "part").union(fresh.select(*KEY, F.lit(part)))
    number = max([int(n) for n in _listed(spark, f"{folder}/manifest")], default=-1) + 1
    after.coalesce(1).write.parquet(f"{folder}/manifest/{number}")
    if manifest(spark, folder).select("part").distinct().count() > most_parts:
        load(spark, folder).write.parquet(f"{folder}/parts/part={part}-all")
        manifest(spark, folder).withColumn("part", F.lit(f"{part}-all")).coalesce(1).write.parquet(f"{folder}/manifest/{number + 1}")
    return load(spark, folder)


def jar_of(paths: list[str], coordinate: str) -> str:
    """The JAR of a class path that `group:name` means; a text without a colon is a path itself.

    Repositories lay JARs out as group folders, name, version: the group either dotted or as folders.
    """
    if ":" not in coordinate:
        return coordinate
    group, name = coordinate.split(":")[:2]
    for path in paths:
        place = "/" + path.replace("\\", "/")
        if place.endswith(".jar") and any(f"/{g}/{name}/" in place for g in (group, group.replace(".", "/"))):
            return path
    raise ValueError(f"no JAR of {coordinate} on the class path")
