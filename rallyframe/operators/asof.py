"""Attributes as known at event time: a bucketed as-of join on availability-ordered versions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.operators.skew import hot_keys, hot_table
from rallyframe.session import buckets_for

_SQL = """
select e.e__, v.r__ from events e asof left join versions v on e.k__ = v.k__ and e.t__ >= v.a__
where v.r__ is not null
"""


def _join(events: pa.Table, versions: pa.Table) -> pa.Table:
    """One bucket: DuckDB's ASOF LEFT JOIN in this worker, on one thread and in memory (it never writes to the worker's disk)."""
    import duckdb

    out = pa.schema([("e__", pa.int64()), ("r__", pa.int64())])
    if not events.num_rows or not versions.num_rows:
        return out.empty_table()
    with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
        db.register("events", events)
        db.register("versions", versions)
        found = db.execute(_SQL).to_arrow_table()
    return found.select(["e__", "r__"]).cast(out)


def current_versions(versions: DataFrame, key: str, valid_from: str, known_on: str, version_id: str) -> DataFrame:
    """The record in force of each key after each day on which its records became available.

    Output ``k__`` (string), ``a__`` (day number from which the state holds), ``r__`` (id of the
    record in force: latest ``valid_from``, then ``known_on``, then id, among those available).
    A record is available from the later of its two dates. Rows with a null key, date or id are
    left out. Ties on one day are resolved here, so there is one row a key and day.
    """
    rows = versions.select(
        F.col(key).cast("string").alias("k__"),
        F.unix_date(F.greatest(F.col(valid_from).cast("date"), F.col(known_on).cast("date"))).alias("a__"),
        F.struct(F.col(valid_from).cast("date").alias("f"), F.col(known_on).cast("date").alias("o"), F.col(version_id).cast("long").alias("i")).alias("s__"),
    ).where(F.col("k__").isNotNull() & F.col("s__.f").isNotNull() & F.col("s__.o").isNotNull() & F.col("s__.i").isNotNull())
    best = rows.groupBy("k__", "a__").agg(F.max("s__").alias("s__"))
    so_far = F.max("s__").over(Window.partitionBy("k__").orderBy("a__"))
    return best.select("k__", "a__", so_far.getField("i").alias("r__"))


def known_at(events: DataFrame, versions: DataFrame, event_id: str, key: str, day: str, version_key: str, valid_from: str, known_on: str, version_id: str, rows_per_bucket: int = 200_000) -> DataFrame:
    """For each event the id of the record that was in force, and known, on the event's day.

    Output: ``event_id``, ``version_id`` (bigint); events with no such record, a null key, day or id
    have no row. Events are hashed by key into buckets of bounded size. A hot key (``hot_keys``: more
    than half of an even task) is salted by its own count: its events spread over buckets of about
    ``rows_per_bucket`` and its versions are copied to each of them, so no bucket grows with one
    key's events. The versions of one key are few (one per day at most). Each bucket runs an embedded
    DuckDB ASOF LEFT JOIN. Repeated event ids each give a row. Either table may be empty.
    """
    spark = events.sparkSession
    ev = events.select(F.col(event_id).cast("long").alias("e__"), F.col(key).cast("string").alias("k__"), F.unix_date(F.col(day).cast("date")).alias("t__")).dropna()
    states = current_versions(versions, version_key, valid_from, known_on, version_id)
    n = events.count()
    b = buckets_for(n, rows_per_bucket, spark)
    hot = hot_keys(ev, ["k__"], at_least=max(rows_per_bucket // 20, 1))
    one = F.lit(0).cast("long")
    if hot:
        table = hot_table(ev, ["k__"], hot)
        ev, states = [df.join(table, "k__", "left") for df in (ev, states)]
        salt = F.when(F.col("salts__").isNotNull(), F.pmod(F.xxhash64("e__"), F.col("salts__"))).otherwise(one)
        copies = F.when(F.col("salts__").isNotNull(), F.sequence(one, F.col("salts__") - 1)).otherwise(F.array(one))
        ev, states = ev.withColumn("z__", salt).drop("salts__"), states.withColumn("z__", F.explode(copies)).drop("salts__")
    else:
        ev, states = [df.withColumn("z__", one) for df in (ev, states)]
    # Two salts of a key may fall into one bucket, so its versions are made distinct there.
    bucket = F.pmod(F.xxhash64("k__", "z__"), F.lit(b)).alias("b__")
    ev, states = ev.select("e__", "k__", "t__", bucket), states.select("k__", "a__", "r__", bucket).distinct()
    found = ev.groupBy("b__").cogroup(states.groupBy("b__")).applyInArrow(_join, "e__ long, r__ long")
    return found.select(F.col("e__").alias(event_id), F.col("r__").alias(version_id))
