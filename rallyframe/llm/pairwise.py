"""Global ranking from pairwise results, by offence-defence scaling of a smoothed win matrix."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.skew import small
from rallyframe.session import partitions, stage

#: Wins, and as many losses, that every item gets against an average opponent of offence and defence 1.
SMOOTHING = 2.0
#: Full iterations between two checkpoints.
UNROLL = 4
#: Entries of an item above which they are split over sub-blocks.
BLOCK = 2_000_000


def offence_defence(results: DataFrame, group: str, winner: str, loser: str, smoothing: float = SMOOTHING, tolerance: float = 1e-4, iterations: int = 400, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """A strength for each item of each group: ``group``, ``item``, ``wins``, ``losses``, ``strength``, ``converged``.

    Sinkhorn iterations on the matrix of wins: an item's offence is the sum over its wins of
    1 / defence of the beaten, its defence the sum over its losses of 1 / offence of the winner, each
    plus ``smoothing``; strength is offence / defence (1 is average). At the fixed point this equals
    the Bradley-Terry strengths of the smoothed results, however uneven the numbers of comparisons.
    Iterations end once no log strength moves by ``tolerance`` between checkpoints; ``converged`` says
    whether that came before ``iterations`` were done.

    Each row is one win. Null groups, winners or losers, and items beating themselves, are left out;
    repeated rows each count; an empty table gives no rows. ``weight`` names a column of what a row
    counts; items that have only rows of weight 0 (or null) have strength 1. Rows are first counted per pair, so an item in a
    third of the rows has at most one entry per opponent. The entries are staged in two
    partitionings, by winner and by loser, in which each half iteration joins the vector it needs
    without moving the entries: only partial sums, one per item and task, are shuffled. An item with
    more than ``block`` entries has them split over sub-blocks, to each of which its number is copied;
    their sums meet in the second level of the next sum.
    """
    spark = results.sparkSession
    p = partitions(spark)
    rows = results.select(F.col(group).cast("string").alias("g"), F.col(winner).cast("string").alias("w"), F.col(loser).cast("string").alias("l"), (F.coalesce(F.col(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)).alias("n")).dropna().where("w <> l")
    pairs = stage(rows.groupBy("g", "w", "l").agg(F.sum("n").alias("n")))
    # An empty entry of each item with itself keeps items without a win or a loss in every sum.
    every = pairs.select("g", F.explode(F.array("w", "l")).alias("w"))
    own = every.groupBy("g", "w").agg(F.lit(0.0).alias("n")).select("g", "w", F.col("w").alias("l"), "n")
    entries = pairs.unionByName(own)
    large = pairs.limit(block + 1).count() > block  # else no item can have more than a block
    sides = {}
    for c, other in (("w", "l"), ("l", "w")):
        split = None
        if large:
            # At most entries / block items are split, so the list of them is short beside the entries.
            split = stage(entries.groupBy("g", c).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > block).select("g", c, F.ceil(F.col("k") / block).cast("int").alias("z")))
            split = split if split.limit(1).count() else None
        if split is not None:
            cut = entries.join(small(split), ["g", c], "left").withColumn("z", F.pmod(F.xxhash64(other), F.coalesce("z", F.lit(1))).cast("int"))
            sides[c] = (stage(cut.repartition(p, "g", c, "z").sortWithinPartitions("g", c, "z"), partitioned=True), split)
        else:
            sides[c] = (stage(entries.repartition(p, "g", c).sortWithinPartitions("g", c), partitioned=True), None)

    def half(at: str, to: str, vector: DataFrame) -> DataFrame:
        edges, split = sides[at]
        v, on = vector.withColumnRenamed("x", "v"), ["g", at]
        if split is not None:
            v = v.join(small(split), on, "left").withColumn("z", F.explode(F.sequence(F.lit(0), F.coalesce("z", F.lit(1)) - 1)))
            on = [*on, "z"]
        return edges.join(v, on).groupBy("g", to).agg((F.sum(F.col("n") / F.col("v")) + smoothing).alias("x"))

    by_winner, by_loser = sides["w"][0], sides["l"][0]
    defence = by_loser.groupBy("g", "l").agg(F.lit(1.0).alias("x"))
    offence, before, converged = None, None, False
    for i in range(math.ceil(iterations / UNROLL)):
        for _ in range(UNROLL):
            offence = half("l", "w", defence)
            defence = half("w", "l", offence)
        both = defence.withColumnRenamed("x", "d").join(offence.select("g", F.col("w").alias("l"), F.col("x").alias("o")), ["g", "l"])
        both = stage(both.select("g", "l", "d", "o", F.log(F.col("o") / F.col("d")).alias("s")), partitioned=True)
        if before is not None:
            moved = both.join(before.select("g", "l", F.col("s").alias("t")), ["g", "l"]).agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0]
            if moved is None or moved <= tolerance:
                converged = True
                break
        before, defence = both, both.select("g", "l", F.col("d").alias("x"))
    won = by_winner.groupBy("g", F.col("w").alias("l")).agg(F.sum("n").cast("long").alias("wins"))
    lost = by_loser.groupBy("g", "l").agg(F.sum("n").cast("long").alias("losses"))
    out = both.join(won, ["g", "l"]).join(lost, ["g", "l"])
    return out.select(F.col("g").alias(group), F.col("l").alias("item"), "wins", "losses", F.exp("s").alias("strength"), F.lit(converged).alias("converged"))


def global_ranks(df: DataFrame, group: str, value: str, tie: str) -> DataFrame:
    """``df`` with ``rank`` (1 for the largest ``value`` of each group; ties by ``tie``), without a task per group.

    Rows are range-partitioned by group and value; each partition counts on from the rows of its
    group in the partitions before it. The driver sees one count per partition and group in it.
    """
    order = [F.asc(group), F.desc(value), F.asc(tie)]
    rows = stage(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order))
    counts = sorted(tuple(r) for r in rows.groupBy(F.spark_partition_id().alias("p"), group).count().collect())
    offsets: dict[int, dict[str, int]] = {}
    seen: dict[str, int] = {}
    for p, g, n in counts:
        offsets.setdefault(p, {})[g] = seen.get(g, 0)
        seen[g] = seen.get(g, 0) + n
    at = df.columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_ = dict(offsets.get(TaskContext.get().partitionId(), {}))
        for b in batches:
            ranks = []
            for g in b.column(at).to_pylist():
                next_[g] = next_.get(g, 0) + 1
                ranks.append(next_[g])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranks, pa.int64())], names=[*b.schema.names, "rank"])

    from pyspark.sql.types import LongType, StructField, StructType

    return rows.mapInArrow(run, StructType([*df.schema.fields, StructField("rank", LongType())]))
