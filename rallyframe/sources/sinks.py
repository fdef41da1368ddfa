"""Writing results: Parquet hand-off between stages, resumable appends, small JSON reports."""

from __future__ import annotations

import json
import math
import os
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.sources.results import exists


def append_new(df: DataFrame, path: str, keys: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Append the rows whose ``keys`` are not yet in the Parquet table at ``path``; returns the rows appended.

    A rerun after a failure appends nothing twice. Of new rows that share their keys all are
    appended; rows with a null key never count as present.
    """
    fresh = df.join(df.sparkSession.read.parquet(path).select(*keys).distinct(), keys, "left_anti") if exists(df.sparkSession, path) else df
    fresh = fresh.select(*df.columns)
    from rallyframe.session import stage

    fresh = stage(fresh)  # the anti join must not read what is being written
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return fresh


def systematic_sample(df: DataFrame, order: list[str], every: int) -> DataFrame:
    """Each ``every``-th row in ``order``, from the first: a ranged sort and counts per partition, no single task."""
    from rallyframe.session import partitions, stage

    rows = stage(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("p__", F.spark_partition_id()).withColumn("i__", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1], r[2]) for r in rows.groupBy("p__").agg(F.min("i__"), F.count(F.lit(1))).collect())
    start, at = [], 0
    for p, low, n in counts:
        start.append((p, at - low))
        at += n
    if not start:
        return rows.drop("p__", "i__")
    offset = F.element_at(F.create_map(*[F.lit(x) for s in start for x in s]), F.col("p__"))
    return rows.where((F.col("i__") + offset) % every == 0).drop("p__", "i__")


def write_report(report: dict, path: str, spark: SparkSession | None = None) -> None:
    """A small report as JSON: dates as text, numbers that are not finite as null.

    With a session it goes to any store that Spark can write, as the one text file of the folder
    ``path``; without, to the file ``path`` on the driver.
    """

    def plain(x):
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        if isinstance(x, list | tuple | set):
            return [plain(v) for v in x]
        if isinstance(x, date | datetime):
            return x.isoformat()
        if hasattr(x, "item"):
            x = x.item()
        return None if isinstance(x, float) and not math.isfinite(x) else x

    if spark is not None:
        spark.createDataFrame([(json.dumps(plain(report)),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        json.dump(plain(report), f, indent=1)


def read_report(path: str, spark: SparkSession | None = None) -> dict:
    """A report that ``write_report`` wrote, with a session or without."""
    if spark is not None:
        return json.loads(spark.read.text(path, wholetext=True).first()[0])
    with open(path) as f:
        return json.load(f)
