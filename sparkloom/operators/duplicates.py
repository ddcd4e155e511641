"""Duplicate code: maximal runs of equal tokens, as islands on diagonals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from sparkloom.operators.clones import settle
from sparkloom.util import Scratch


def duplicates(tokens: DataFrame, scratch: Scratch, least: int = 50) -> DataFrame:
    """(file_a, start_a, file_b, start_b, length, lines) of maximal equal runs of `least` tokens or more.

    tokens (file, offset, text, line). Every window of `least` tokens has a hash; windows of equal
    hash and equal text are paired, consecutive starts on one diagonal (both files and their distance)
    make an island, whose run is islands + least - 1 tokens. In one file a run may not overlap its
    copy: it is cut to their distance, at its end. Each row of a bucket is paired with the ones after
    it, so copies in m places give m(m-1)/2 runs: that is the result's own size.
    """
    w = Window.partitionBy("file").orderBy("offset").rowsBetween(0, least - 1)
    text = F.collect_list("text").over(w)
    wins = tokens.select("file", "offset", text.alias("win")).filter(F.size("win") == least).select("file", "offset", F.xxhash64("win").alias("h"), F.sha2(F.array_join("win", "\u0001"), 256).alias("same"))
    shared = wins.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    wins = scratch.keep(wins.join(shared, "h"))
    a = wins.select("h", "same", F.col("file").alias("file_a"), F.col("offset").alias("a"))
    b = wins.select("h", "same", F.col("file").alias("file_b"), F.col("offset").alias("b"))
    pairs = a.join(b, ["h", "same"]).filter("file_a < file_b or (file_a = file_b and a < b)").select("file_a", "file_b", "a", (F.col("b") - F.col("a")).alias("d"))
    diagonal = Window.partitionBy("file_a", "file_b", "d").orderBy("a")
    runs = pairs.withColumn("island", F.col("a") - F.row_number().over(diagonal)).groupBy("file_a", "file_b", "d", "island").agg(F.min("a").alias("a"), (F.count(F.lit(1)) + least - 1).alias("full"))
    cut = F.when(F.col("file_a") == F.col("file_b"), F.least("full", "d")).otherwise(F.col("full"))
    runs = runs.withColumn("length", cut.cast("int")).filter(F.col("length") >= least).withColumn("start_a", (F.col("a") + F.col("full") - F.col("length")).cast("int"))
    runs = runs.select("file_a", "start_a", "file_b", (F.col("start_a") + F.col("d")).alias("start_b"), "length")
    line = tokens.select("file", "offset", "line")
    for side in ("a", "b"):
        for end, at in (("first", F.col(f"start_{side}")), ("last", F.col(f"start_{side}") + F.col("length") - 1)):
            where = line.select(F.col("file").alias(f"file_{side}"), F.col("offset").alias("at"), F.col("line").alias(f"{end}_line_{side}"))
            runs = runs.withColumn("at", at).join(where, [f"file_{side}", "at"]).drop("at")
    return runs


KEPT = "file_a string, start_a int, file_b string, start_b int, length int"


def without_covered(runs: DataFrame) -> DataFrame:
    """Runs (KEPT) both of whose ranges are not inside ranges of longer runs that stay, by length, then files and places."""
    ends = [runs.select(F.col(f"file_{x}").alias("file"), F.col(f"start_{x}").alias("off"), "length", F.col(f"file_{y}").alias("pfile"), F.col(f"start_{y}").alias("poff")) for x, y in ("ab", "ba")]
    return settle(ends[0].union(ends[1]))
