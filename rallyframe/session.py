"""Session, staging and sizing helpers shared by every operator."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rallyframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where none is set (tests)."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if shared:
        if not current:
            spark.sparkContext.setCheckpointDir(shared)
        return shared
    if not current:
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "rallyframe-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage there.

    With ``partitioned`` the staged rows keep the partitioning and order of ``df`` for later joins;
    adaptive execution would forget both, so it is off while they are written.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not partitioned:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def stage_table(df: DataFrame, free: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared checkpoint folder and read it from there.

    Compressed and columnar, so the better choice for wide or large rows of which later steps read
    some columns. The table is deleted when the application ends. With ``free`` the shuffle files that
    made it are let go at once; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if free:
        gc.collect()
        jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def worker_memory(name: str) -> dict:
    """A dictionary that lasts as long as its Python worker, over all its tasks; code that is sent by value has no other such place."""
    place = sys.modules.setdefault("rallyframe_worker_memory", types.ModuleType("rallyframe_worker_memory"))
    return place.__dict__.setdefault(name, {})


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions: the width every explicit repartition here follows."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets_for(rows: int, rows_per_bucket: int, spark: SparkSession) -> int:
    """Bucket count that keeps a bucket near ``rows_per_bucket`` rows at any input size."""
    return max(partitions(spark), -(-rows // rows_per_bucket))
