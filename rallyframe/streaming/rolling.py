"""The match operators on unbounded input: windowed activity with late rows, duplicates dropped, ratings kept between batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.ratings import FAMILIES, STATE, RatingConfig, ratings_and_states
from rallyframe.sources.results import exists


def activity(events: DataFrame, time: str, key: str, value: str, window: str = "7 days", slide: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and sum of ``value`` per key and sliding window of event time; rows later than ``late`` are dropped.

    Works on a stream (append mode) and on a table alike. State is bounded by the watermark.
    """
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def first_seen(events: DataFrame, time: str, identity: list[str], late: str = "2 days") -> DataFrame:
    """Each identity once within the watermark, whichever copy comes first."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(identity) if events.isStreaming else events.dropDuplicates(identity)


def rate_batches(path: str, sink: Callable[[DataFrame, int], None], config: RatingConfig | None = None, row_id: str = "row_id") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that rates each batch's matches against all earlier ones.

    Under ``path`` are two Parquet tables by batch: ``states``, the players' states before the last
    day seen, and ``matches``, of which only ids and the rows of that last day are read. A batch is
    folded on from the states, so its cost follows the batch and the players and not the history.
    Matches already taken in, by ``row_id``, are skipped, and a batch that is run again starts from
    the states before it, so it changes nothing. Batches must come in order of days; a day may be
    spread over batches and is rated from the days before it all the same.
    """
    history, saved = f"{path}/matches", f"{path}/states"

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([row_id])
        states, open_rows = None, None
        if exists(spark, history):
            old = spark.read.parquet(history).where(F.col("batch__") < batch_id)
            fresh = fresh.join(old.select(row_id), row_id, "left_anti")
        if exists(spark, saved):
            every = spark.read.schema(f"{STATE}, batch__ int").parquet(saved).where(F.col("batch__") < batch_id)
            last = every.agg(F.max("batch__")).first()[0]
            if last is not None:
                states = every.where(F.col("batch__") == last).drop("batch__")
                open_rows = old.join(F.broadcast(states.agg(F.min("day").alias("day"))), F.unix_date("proxy_date") >= F.col("day")).drop("day", "batch__")
        fresh = fresh.select(*batch.columns).persist()
        if fresh.limit(1).count():
            rows = fresh if open_rows is None else open_rows.select(*batch.columns).unionByName(fresh)
            rated, after = ratings_and_states(rows, row_id, config=config, states=states)
            sink(rated.join(fresh.select(row_id), row_id, "left_semi").select(row_id, *[f"{s}_{f}" for s in ("w", "l") for f in FAMILIES], "expected"), batch_id)
            for df, to in ((fresh, history), (after, saved)):
                df.withColumn("batch__", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch__").parquet(to)
        fresh.unpersist()

    return run
