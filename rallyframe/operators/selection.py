"""Top fractions per group, grids of selections in one job, nearest choices with fallbacks."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.operators.metrics import period_summary
from rallyframe.session import stage

#: Rows of a grid that are broadcast at a time.
GRID_ROWS = 10_000


def top_fraction(df: DataFrame, group: str, order: list[Column], fraction: float, eligible: Column | None = None) -> DataFrame:
    """Of each group the first ``max(1, ceil(fraction * size))`` eligible rows in ``order``, with ``place`` and ``cap``.

    The size counts all rows of the group, eligible or not. ``order`` should be total; null groups are a group.
    """
    sized = df.withColumn("size__", F.count(F.lit(1)).over(Window.partitionBy(group)))
    rows = sized.where(eligible) if eligible is not None else sized
    rows = rows.withColumn("cap", F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * F.col("size__")).cast("int"))).drop("size__")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("place <= cap")


def grid_top_fraction(df: DataFrame, group: str, order: list[Column], grid: DataFrame, eligible: Column) -> DataFrame:
    """``top_fraction`` for every row of ``grid`` (``policy``, ``fraction`` and the parameters of ``eligible``) in one job.

    The grid is a stated set of parameters, broadcast against the rows GRID_ROWS of it at a time, and
    each (policy, group) is selected on its own. Policies should have different names.
    """
    blocks = max(1, -(-grid.count() // GRID_ROWS))
    if blocks > 1:
        cut = [grid.where(F.pmod(F.xxhash64("policy"), F.lit(2 * blocks)) == i) for i in range(2 * blocks)]
        return reduce(DataFrame.unionByName, [_grid_block(df, group, order, g, eligible) for g in cut])
    return _grid_block(df, group, order, grid, eligible)


def _grid_block(df: DataFrame, group: str, order: list[Column], grid: DataFrame, eligible: Column) -> DataFrame:
    sized = df.withColumn("size__", F.count(F.lit(1)).over(Window.partitionBy(group)))
    met = sized.join(F.broadcast(grid), eligible)
    met = met.withColumn("cap", F.greatest(F.lit(1), F.ceil(F.col("fraction").cast("double") * F.col("size__")).cast("int"))).drop("size__")
    return met.withColumn("place", F.row_number().over(Window.partitionBy("policy", group).orderBy(*order))).where("place <= cap")


def choose(df: DataFrame, tiers: list[tuple[Column, list[Column]]]) -> DataFrame:
    """One row: the first, in the first tier that has any; a tier is a condition and an order. No rows if no tier has one."""
    for condition, order in tiers:
        found = stage(df.where(condition).orderBy(*order).limit(1))
        if found.count():
            return found
    return df.limit(0)


def grid_summary(df: DataFrame, group: str, order: list[Column], grid: DataFrame, eligible: Column, period: str | Column, value: str) -> DataFrame:
    """``period_summary`` of what each policy of a grid selects, all policies in one job; policies that select nothing have no row."""
    return period_summary(grid_top_fraction(df, group, order, grid, eligible), ["policy"], period, value)


@dataclass(frozen=True)
class Selection:
    """A selection that can be stored and applied: a top fraction per group among rows within bounds.

    ``least`` and ``most`` are bounds of columns, both inclusive; a row with a null in one of them is
    not eligible. ``order`` lists columns, a leading ``-`` meaning descending.
    """

    name: str
    group: str
    fraction: float
    order: tuple[str, ...]
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        eligible = F.lit(True)
        for c, x in self.least.items():
            eligible = eligible & (F.col(c) >= F.lit(x))
        for c, x in self.most.items():
            eligible = eligible & (F.col(c) <= F.lit(x))
        order = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in self.order]
        return top_fraction(df, self.group, order, self.fraction, F.coalesce(eligible, F.lit(False)))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Selection:
        x = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return Selection(**x | {"order": tuple(x["order"])})
