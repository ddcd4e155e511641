"""Two texts compared line by line, place by place, with built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Fixed value: what ends a line.
ENDS = r"\r\n|\n|\r"


def diff_lines(rows: DataFrame, keys: list[str], before: str = "before", after: str = "after") -> DataFrame:
    """(keys, line, sign, text): the lines that differ at the same place, numbered from 1; `-` as it was, `+` as it is.

    Lines are compared by their place only, so one that is put in makes all below it differ. A null text has no
    lines, an empty one has one. Work and memory are those of one row.
    """
    split = lambda c: F.coalesce(F.split(c, ENDS, -1), F.array().cast("array<string>"))
    pairs = F.arrays_zip(split(F.col(before)).alias("old"), split(F.col(after)).alias("new"))
    lines = rows.select(*keys, F.posexplode(pairs).alias("at", "pair")).select(*keys, (F.col("at") + 1).alias("line"), "pair.*")
    lines = lines.toDF(*keys, "line", "old", "new").filter(~F.col("old").eqNullSafe(F.col("new")))
    both = F.array(F.struct(F.lit("-").alias("sign"), F.col("old").alias("text")), F.struct(F.lit("+").alias("sign"), F.col("new").alias("text")))
    return lines.select(*keys, "line", F.inline(both)).filter("text is not null")
