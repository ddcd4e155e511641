"""Session helpers shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


#: Rows of an Arrow batch in tables that are written in between.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only where the session names none and runs on one machine a temporary folder is set; a cluster must name one.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_loom_shared", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark._loom_shared = "file://" + tempfile.mkdtemp(prefix="loom-")
    return path.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        """Write df once and read it back. Arrow batches of the write are small: rows may be long texts."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        conf, key = self.spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = int(conf.get(key))
        conf.set(key, min(before, BATCH_ROWS) if before > 0 else BATCH_ROWS)
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.set(key, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._loom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing later reads."""
        jvm = self.spark._jvm
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df._loom_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def with_row_keys(rows: DataFrame, id_col: str, body: Column, scratch: Scratch, merge: bool) -> DataFrame | None:
    """rows and row_key, a long for each row, in the order of id (null first), body and place; None if every id is there once.

    merge: rows that have an id and are equal in it and in body share a key.
    """
    if rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("m")).filter(F.col(id_col).isNull() | (F.col(id_col) == -(2**63)) | (F.col("m") > 1)).isEmpty():
        return None
    kept = scratch.keep(rows.select("*", body.alias("row_body"), F.monotonically_increasing_id().alias("row_at")))
    at = F.when(F.col(id_col).isNull(), F.col("row_at")) if merge else F.col("row_at")
    three = lambda *names: (x.alias(n) for x, n in zip((F.col(id_col), F.col("row_body"), at), names, strict=True))
    keys = scratch.keep(kept.select(*three("k1", "k2", "k3")).distinct().orderBy(F.asc_nulls_first("k1"), "k2", "k3").select("*", F.monotonically_increasing_id().alias("row_key")))
    same = F.col(id_col).eqNullSafe(F.col("k1")) & (F.col("row_body") == F.col("k2")) & at.eqNullSafe(F.col("k3"))
    out = scratch.keep(kept.join(keys, same).select(*rows.columns, "row_key"))
    scratch.drop(kept, keys)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
