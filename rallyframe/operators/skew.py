"""Skew handling: exact hot keys, and joins that keep hot keys off single tasks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.session import partitions

#: Rows that a key needs at least before it can count as hot.
LEAST_ROWS = 10_000
#: Rows up to which a table of a few columns may be broadcast (a few MB).
SMALL_ROWS = 50_000


def hot_keys(df: DataFrame, keys: list[str], at_least: int = LEAST_ROWS) -> dict[tuple, int]:
    """The keys that hold more than half of an even task's rows, counted exactly, each with the tasks it should spread over.

    An even task has the rows over the session's shuffle partitions, so what counts as hot follows
    input and cluster and no key that stays whole is more than half a task. There can be at most two
    such keys a partition, which bounds the list whatever the input. Partial counts run before the
    shuffle, so a hot key costs one row a partition. Null keys never count as hot, as they join with
    nothing. An empty table has no hot keys.
    """
    width = partitions(df.sparkSession)
    counts = df.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n__"))
    most = counts.where(F.col("n__") >= at_least).orderBy(F.desc("n__")).limit(2 * width).collect()
    if not most:
        return {}
    half = max(df.count() / (2 * width), at_least / 2)
    return {tuple(r[k] for k in keys): max(2, math.ceil(r["n__"] / half)) for r in most if r["n__"] > half}


def hot_table(like: DataFrame, keys: list[str], hot: dict[tuple, int], salts: str = "salts__") -> DataFrame:
    """The hot keys as a broadcast table of ``keys`` and ``salts``; bounded as ``hot_keys`` says."""
    schema = like.select(*keys).schema.add(salts, "long")
    return F.broadcast(like.sparkSession.createDataFrame([(*k, n) for k, n in hot.items()], schema))


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, counted no further; else as it is, for a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a ``right`` that may be small: a broadcast behind a row count, beyond it ``skew_join``."""
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, how)


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", at_least: int = LEAST_ROWS, hot: dict[tuple, int] | None = None) -> DataFrame:
    """Equi-join of a possibly skewed ``left``.

    Rows of ``left`` with a hot key spread over as many sub-keys as ``hot_keys`` says, and the
    ``right`` rows of a hot key are copied to each; all others have one sub-key. So both tables are
    read and shuffled once, whatever the skew. ``hot`` may give the hot keys where the caller has
    counted them. ``how`` is inner or left. Keys are compared with ``=``: null keys match nothing, and
    a left join keeps their rows, spread over the tasks.
    """
    hot = hot_keys(left, keys, at_least) if hot is None else hot
    one = F.lit(0).cast("long")
    absent = F.lit(False)
    for k in keys:
        absent = absent | F.col(k).isNull()
    place = lambda n: F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), n)
    spread = place(F.lit(2 * partitions(left.sparkSession)).cast("long"))
    if not hot:
        if how == "inner":
            return left.join(right, keys, how)
        salted = left.withColumn("salt__", F.when(absent, spread).otherwise(one))
        return salted.join(right.withColumn("salt__", one), [*keys, "salt__"], how).drop("salt__")
    table = hot_table(left, keys, hot)
    salted = left.join(table, keys, "left").withColumn("salt__", F.when(F.col("salts__").isNotNull(), place(F.col("salts__"))).when(absent, spread).otherwise(one)).drop("salts__")
    copies = F.when(F.col("salts__").isNotNull(), F.sequence(one, F.col("salts__") - 1)).otherwise(F.array(one))
    spread_right = right.join(table, keys, "left").withColumn("salt__", F.explode(copies)).drop("salts__")
    return salted.join(spread_right, [*keys, "salt__"], how).drop("salt__")
