"""Rolling totals over trailing periods, with rows for the days without activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rolling_totals(df: DataFrame, entity: str, day: str, value: str, periods: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Totals and means of ``value`` over the trailing ``periods`` days, a row per entity and day.

    Output: ``entity``, ``day`` (date), and ``sum_<p>d``, ``mean_<p>d`` (double) for each period p.
    Every calendar day from the entity's first to its last ``day`` gets a row. A sum covers the days
    ``day - p + 1`` to ``day``; a mean is the sum over the fixed denominator p. Null values count as
    nothing and days without a value sum to 0; NaN and infinite values are treated as null. Rows
    with a null entity or day are left out; repeated rows each count. An empty table gives no rows.

    Rows are first summed per entity and day (partial sums before the one shuffle, so an entity that
    holds a third of all rows is at most one row per day afterwards). Sums can only change on an
    active day or p days after one, so range frames run on those change points alone, and the
    calendar rows between two change points are generated from the earlier one.
    """
    v = F.when(F.abs(F.col(value).cast("double")) < F.lit(float("inf")), F.col(value).cast("double"))
    daily = (
        df.select(F.col(entity).alias("e__"), F.to_date(F.col(day)).alias("d__"), v.alias("v__"))
        .where("e__ is not null and d__ is not null")
        .groupBy("e__", "d__")
        .agg(F.sum("v__").alias("v__"))
        .select("e__", F.unix_date("d__").alias("n__"), "v__")
    )
    last = F.max("n__").over(Window.partitionBy("e__"))
    steps = F.array(F.lit(0), *[F.lit(p) for p in periods])
    active = daily.withColumn("last__", last)
    points = (
        active.select("e__", "last__", F.col("n__").alias("a__"), "v__", F.explode(steps).alias("s__"))
        .select("e__", "last__", (F.col("a__") + F.col("s__")).alias("n__"), F.when(F.col("s__") == 0, F.col("v__")).alias("v__"))
        .where("n__ <= last__")
    )
    points = points.groupBy("e__", "n__").agg(F.sum("v__").alias("v__"), F.max("last__").alias("last__"))
    by_day = Window.partitionBy("e__").orderBy("n__")
    sums = points.select(
        "e__",
        "n__",
        F.coalesce(F.lead("n__").over(by_day) - 1, F.col("last__")).alias("until__"),
        *[F.coalesce(F.sum("v__").over(by_day.rangeBetween(-(p - 1), 0)), F.lit(0.0)).alias(f"sum_{p}d") for p in periods],
    )
    means = [(F.col(f"sum_{p}d") / F.lit(float(p))).alias(f"mean_{p}d") for p in periods]
    return sums.withColumn("n__", F.explode(F.sequence("n__", "until__"))).select(
        F.col("e__").alias(entity), F.date_from_unix_date("n__").alias(day), *[f"sum_{p}d" for p in periods], *means
    )
