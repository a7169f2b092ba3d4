"""Shared scratch tables: written Parquet that cuts lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where scratch tables go in local mode when the session names no checkpoint folder (tests); it goes with the process.
LOCAL_FALLBACK = f"/tmp/treeloom-scratch-{os.getpid()}"
atexit.register(shutil.rmtree, LOCAL_FALLBACK, ignore_errors=True)


def root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the session.

    Only a session in local mode may leave it unset; then everything runs on one machine."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{LOCAL_FALLBACK}"


#: Rows and bytes of an Arrow batch at most: texts and packs are long, and a batch is held on both sides of the pipe.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Have this session cut Arrow batches small enough for rows that hold whole texts or packs; smaller settings stay."""
    number = {"maxRecordsPerBatch": int, "maxBytesPerBatch": spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes}
    for setting, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{setting}"
        if not 0 < number[setting](spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


class Scratch:
    """Written tables that cut lineage: a lost executor re-reads them instead of recomputing everything before.

    Tables can be dropped as soon as nothing that is still to run reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        small_batches(spark)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.count += 1
        path = f"{self.path}/{name}-{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, t._scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder by Hadoop's file system, whichever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that no plan refers to any more, before the next large shuffle."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def space(spark: SparkSession, path: str) -> tuple[int, int]:
    """Free bytes and all bytes of a path's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getStatus()
    return status.getRemaining(), status.getCapacity()
