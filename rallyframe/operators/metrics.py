"""Metrics of predicted probabilities, calibration tables, bootstrap, and summaries over periods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1.
CLIP = 1e-6
#: Cells of equal width that probabilities are sorted in.
CELLS = 4096


def _clipped(p: str) -> Column:
    x = F.col(p).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(CLIP)), F.lit(1 - CLIP)))


def grouped_metrics(df: DataFrame, keys: list[str], target: str = "target", probability: str = "p") -> DataFrame:
    """``n``, ``accuracy``, ``brier``, ``log_loss`` and ``auc`` per group (one row over all for no keys; none for an empty table).

    Rows without a target or probability are left out. AUC is the Mann-Whitney statistic with mean
    ranks for ties, null if a group has one class. Rows are first counted per group, probability and
    class; ranks need only those counts. Counts below a probability are those of the lower ones of
    CELLS equal cells, of which a group has few, and of the lower ones in its own cell, so no task
    sorts a whole group.
    """
    rows = df.select(*keys, F.col(target).cast("int").alias("y"), _clipped(probability).alias("p")).where("y is not null and p is not null and not isnan(p)")
    counts = rows.groupBy(*keys, "p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("all"))
    counts = counts.withColumns({"neg": F.col("all") - F.col("pos"), "cell": F.floor(F.col("p") * CELLS)})
    before = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("neg").over(before([*keys, "cell"], "p")), F.lit(0))
    cells = counts.groupBy(*[F.col(k).alias(f"{k}__") for k in keys], F.col("cell").alias("cell__")).agg(F.sum("neg").alias("n__"))
    cells = cells.withColumn("lower__", F.coalesce(F.sum("n__").over(before([f"{k}__" for k in keys], "cell__")), F.lit(0))).drop("n__")
    same = F.col("cell") == F.col("cell__")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}__"))
    counts = counts.withColumn("inside__", inside).join(cells, same).withColumn("under", F.col("inside__") + F.col("lower__"))
    n, pos, negs = F.sum("all"), F.sum("pos"), F.sum("neg")
    right = F.sum(F.when(F.col("p") >= 0.5, F.col("pos")).otherwise(F.col("neg")))
    brier = F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + F.col("neg") * F.col("p") * F.col("p"))
    loss = -F.sum(F.col("pos") * F.ln("p") + F.col("neg") * F.ln(1 - F.col("p")))
    wins = F.sum(F.col("pos") * (F.col("under") + 0.5 * F.col("neg")))
    aggs = [n.alias("n"), F.try_divide(right.cast("double"), n).alias("accuracy"), F.try_divide(brier, n).alias("brier"), F.try_divide(loss, n).alias("log_loss"), F.try_divide(wins.cast("double"), (pos * negs).cast("double")).alias("auc")]
    out = counts.groupBy(*keys).agg(*aggs)
    return out.where("n is not null and n > 0")


def model_metrics(df: DataFrame, probabilities: list[str], target: str = "target") -> DataFrame:
    """``grouped_metrics`` of several probability columns, a row per ``model``."""
    long = df.select(F.col(target).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("model"), F.col(c).cast("double").alias("p")) for c in probabilities])).alias("x"))
    return grouped_metrics(long.select("y", "x.model", "x.p"), ["model"], "y", "p")


def calibration_table(df: DataFrame, target: str = "target", probability: str = "p", bins: int = 10) -> DataFrame:
    """Per quantile bin of the probability: ``low``, ``high`` (right-closed), ``n``, ``mean_prediction``, ``win_rate``, ``error``.

    Edges are exact linear quantiles; equal edges are merged. A table of one probability has one bin.
    """
    rows = df.select(F.col(target).cast("double").alias("y"), F.col(probability).cast("double").alias("p")).where("y is not null and p is not null and not isnan(p)")
    edges = rows.agg(F.percentile("p", F.array(*[F.lit(i / bins) for i in range(bins + 1)])).alias("e")).first()["e"]
    if edges is None:
        return df.sparkSession.createDataFrame([], "low double, high double, n long, mean_prediction double, win_rate double, error double")
    edges = sorted(set(edges))
    edges = edges if len(edges) > 1 else edges * 2
    place = F.lit(0)
    for e in edges[1:-1]:
        place = place + (F.col("p") > F.lit(e)).cast("int")
    lows, highs = F.array(*[F.lit(e) for e in edges[:-1]]), F.array(*[F.lit(e) for e in edges[1:]])
    out = rows.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_prediction"), F.avg("y").alias("win_rate"))
    return out.select(F.element_at(lows, F.col("b") + 1).alias("low"), F.element_at(highs, F.col("b") + 1).alias("high"), "n", "mean_prediction", "win_rate", (F.col("win_rate") - F.col("mean_prediction")).alias("error"))


def bands(c: str | Column, edges: list[float]) -> Column:
    """The left-closed band of a value as ``[low, high)``; null outside."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:], strict=False))):
        out = F.when((c >= low) & (c < high), F.lit(f"[{low:g}, {high:g})")).otherwise(out)
    return out


def period_summary(df: DataFrame, keys: list[str], period: str | Column, value: str) -> DataFrame:
    """Two-level summary of ``value``: over all rows, and over the means of periods.

    Per group ``n``, ``total``, ``mean``, ``hit_rate`` (values above 0), ``total_without_best`` (the
    largest value left out), ``periods``, ``median_period``, ``worst_period`` and ``good_periods``
    (share with a mean above 0).
    """
    p = F.col(period) if isinstance(period, str) else period
    rows = df.select(*keys, p.alias("period"), F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    by = rows.groupBy(*keys, "period").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.max("v").alias("top"), F.sum((F.col("v") > 0).cast("long")).alias("hits"))
    by = by.withColumn("m", F.col("s") / F.col("n"))
    out = by.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("s").alias("total"), F.sum("hits").alias("hits"), F.max("top").alias("top"), F.count(F.lit(1)).alias("periods"),
        F.median("m").alias("median_period"), F.min("m").alias("worst_period"), F.avg((F.col("m") > 0).cast("double")).alias("good_periods"),
    )
    return out.where("n > 0").select(*keys, "n", "total", (F.col("total") / F.col("n")).alias("mean"), (F.col("hits") / F.col("n")).alias("hit_rate"), (F.col("total") - F.greatest("top", F.lit(0.0))).alias("total_without_best"), "periods", "median_period", "worst_period", "good_periods")


def largest_fall(df: DataFrame, keys: list[str], order: list[str], value: str, period: str | None = None) -> DataFrame:
    """``largest_fall`` of the running sum of ``value`` in ``order`` below its peak so far, the peak at least 0.

    With ``period`` (the leading part of the order) the sequence of each group is cut by period:
    each is folded on its own to its sum, peak and fall, and the few period rows are folded in turn,
    so a group's rows never meet in one task.
    """
    cut = [*keys, period] if period else keys
    rest = [c for c in order if c != period]
    so_far = Window.partitionBy(*cut).orderBy(*rest).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*cut, *rest, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).withColumn("s", F.sum("v").over(so_far))
    rows = rows.withColumns({"peak": F.max("s").over(so_far)})
    # Within a part: its sum, highest point, fall from its own points, and lowest point.
    parts = rows.groupBy(*cut).agg(F.sum("v").alias("sum"), F.max("peak").alias("peak"), F.min("s").alias("low"), F.max(F.col("peak") - F.col("s")).alias("fall"))
    if not period:
        # The peak is at least the start, 0: a fall from the start is the lowest point.
        return parts.select(*keys, F.greatest("fall", -F.col("low"), F.lit(0.0)).alias("largest_fall"))
    before = Window.partitionBy(*keys).orderBy(period).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0.0)))
    parts = parts.withColumn("top", F.greatest(F.coalesce(F.max(F.col("start") + F.col("peak")).over(before), F.lit(0.0)), F.lit(0.0)))
    return parts.groupBy(*keys).agg(F.max(F.greatest("fall", F.col("top") - F.col("start") - F.col("low"), F.lit(0.0))).alias("largest_fall"))


def bootstrap_mean(df: DataFrame, value: str, resamples: int = 3000, seed: int = 260904, buckets: int = 64) -> DataFrame:
    """5th, 50th and 95th percentile of the mean of ``value`` over resamples of all rows: ``p05``, ``p50``, ``p95``.

    Each resample draws as many rows as there are, with replacement. Rows are counted by value and
    values hashed into ``buckets``; a resample's draws fall to the buckets as one multinomial, which
    every bucket makes alike from the resample's seed, and to the values of a bucket as another. So no
    task holds the column, and the result depends on the values and not on how rows are spread. An
    empty table gives nulls.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    rows = rows.groupBy("v").agg(F.count(F.lit(1)).alias("k")).withColumn("b", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, dtype=np.int64)
    for b, n in rows.groupBy("b").agg(F.sum("k")).collect():
        sizes[b] = n
    total = int(sizes.sum())

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("v").to_numpy(), kind="stable")
        v, k, own = t.column("v").to_numpy()[order], t.column("k").to_numpy()[order], t.column("b")[0].as_py()
        sums = np.empty(resamples)
        for i in range(resamples):
            drawn = np.random.default_rng([seed, i]).multinomial(total, sizes / total)[own]
            sums[i] = np.random.default_rng([seed, i, own]).multinomial(drawn, k / k.sum()) @ v
        return pa.table({"i": pa.array(np.arange(resamples)), "s": pa.array(sums)})

    means = rows.groupBy("b").applyInArrow(run, "i long, s double").groupBy("i").agg((F.sum("s") / F.lit(float(max(total, 1)))).alias("m"))
    q = F.percentile("m", F.array(*[F.lit(x) for x in (0.05, 0.5, 0.95)]))
    return means.agg(q.alias("q")).select(*[F.col("q")[i].alias(f"p{x}") for i, x in enumerate(("05", "50", "95"))])


def quality_summary(audit: DataFrame, status: str, measures: list[str]) -> DataFrame:
    """Per status: ``n``, ``share`` of all rows, and median and 5th percentile of each measure."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        aggs += [F.percentile(m, F.lit(0.5)).alias(f"{m}_median"), F.percentile(m, F.lit(0.05)).alias(f"{m}_p05")]
    by = audit.groupBy(status).agg(*aggs)
    total = by.agg(F.sum("n").alias("all__"))
    return by.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("all__")).drop("all__")  # one row: a bound of 1


def median_and_scale(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float, float]]:
    """Median, and mean and population deviation after filling with it, of each column; a deviation under 1e-8 is 1."""
    medians = df.agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in columns]).first()
    fill = {c: 0.0 if medians[c] is None else float(medians[c]) for c in columns}
    filled = {c: F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(fill[c])) for c in columns}
    row = df.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(filled.values()) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out = {}
    for i, c in enumerate(columns):
        s = row[f"s{i}"] or 0.0
        out[c] = (fill[c], row[f"m{i}"] or 0.0, s if s >= 1e-8 else 1.0)
    return out
