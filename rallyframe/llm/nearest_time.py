"""Nearest record in time per entity, by a piecewise-linear learned index over entity-time shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.skew import skew_join
from rallyframe.session import buckets_for

#: Days of one time shard.
SHARD_DAYS = 365
#: Places that a linear piece of the index may be wrong by.
MOST_ERROR = 8


class LearnedIndex:
    """Positions in a sorted integer array, predicted by linear pieces with a bounded error.

    ``shards`` gives the shard of each key, never falling; a piece belongs to one shard. Each shard
    starts as one piece, the line through its ends, and pieces that err by more than MOST_ERROR on a
    key of theirs are cut in half until none does, so a search never leaves prediction +- error + 1.
    """

    def __init__(self, keys: np.ndarray, shards: np.ndarray) -> None:
        n = len(keys)
        self.keys, place = keys, np.arange(n)
        start = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]])
        while True:
            end = np.r_[start[1:], n] - 1
            self.start, self.end, self.low = start, end, keys[start]
            self.slope = (end - start) / np.maximum(keys[end] - self.low, 1)
            error = np.abs(self._guess(np.repeat(np.arange(len(start)), end - start + 1), keys) - place)
            wrong = np.flatnonzero(np.maximum.reduceat(error, start) > MOST_ERROR)
            if not len(wrong):
                return
            start = np.sort(np.r_[start, (start[wrong] + end[wrong] + 1) // 2])

    def _guess(self, piece: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.start[piece] + np.rint((x - self.low[piece]) * self.slope[piece]).astype(np.int64)

    def first_at_least(self, x: np.ndarray) -> np.ndarray:
        """For each x the first position whose key is >= x (the array's length if there is none)."""
        piece = np.maximum(np.searchsorted(self.low, x, side="left") - 1, 0)
        guess, first, last = self._guess(piece, x), self.start[piece], self.end[piece] + 1
        lo, hi = np.clip(guess - MOST_ERROR - 1, first, last), np.clip(guess + MOST_ERROR + 2, first, last)
        while True:
            open_ = lo < hi
            if not open_.any():
                return lo
            mid = (lo + hi) // 2
            less = np.zeros(len(x), dtype=bool)
            less[open_] = self.keys[mid[open_]] < x[open_]
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)


_OUT = pa.schema([("h__", pa.int64()), ("g__", pa.int64()), ("d__", pa.int32()), ("r__", pa.int64())])


def _search(tolerance: int):
    def run(queries: pa.Table, records: pa.Table) -> pa.Table:
        if not queries.num_rows or not records.num_rows:
            return _OUT.empty_table()
        col = lambda t, c: t.column(c).to_numpy()
        both = np.empty(queries.num_rows + records.num_rows, dtype=[("h", "i8"), ("g", "i8"), ("s", "i4")])
        for c in both.dtype.names:
            both[c] = np.concatenate([col(queries, f"{c}__"), col(records, f"{c}__")])
        _, code = np.unique(both, return_inverse=True)  # a number for each shard, of an entity and a stretch of time
        nq = queries.num_rows
        qd, rd = col(queries, "d__").astype(np.int64), col(records, "d__").astype(np.int64)
        base = min(qd.min(), rd.min()) - tolerance - 1
        wide = max(qd.max(), rd.max()) - base + tolerance + 2
        rk = code[nq:] * wide + (rd - base)
        order = np.argsort(rk, kind="stable")
        rk, ids = rk[order], col(records, "r__")[order]
        qk = code[:nq] * wide + (qd - base)
        after = LearnedIndex(rk, code[nq:][order]).first_at_least(qk)
        ahead = np.where(after < len(rk), rk[np.minimum(after, len(rk) - 1)] - qk, tolerance + 1)
        behind = np.where(after > 0, qk - rk[np.maximum(after - 1, 0)], tolerance + 1)
        pick = np.where(behind <= ahead, after - 1, after)
        keep = np.flatnonzero(np.minimum(ahead, behind) <= tolerance)
        return pa.table([queries.column("h__").take(keep), queries.column("g__").take(keep), queries.column("d__").take(keep), pa.array(ids[pick[keep]])], schema=_OUT)

    return run


def nearest_in_time(queries: DataFrame, records: DataFrame, query_id: str, record_id: str, keys: list[str], query_day: str, record_day: str, tolerance: int, rows_per_bucket: int = 500_000) -> DataFrame:
    """For each query row the record of the same entity with the fewest days between, within ``tolerance``.

    Output ``query_id``, ``record_id`` (bigint). The entity is the tuple of ``keys`` (strings, equal
    as they stand). Ties go to the earlier day, then the smaller record id. Rows with a null key,
    day or id match nothing; repeated query rows each get their answer; either table may be empty.

    Records are first reduced to the smallest id per entity and day and queries to distinct entity
    days, so an entity that holds a third of the rows leaves at most one row a day. Both are cut
    into time shards; a record within ``tolerance`` of a shard's edge goes to the neighbour too, so
    each shard answers its own queries alone. Shards are hashed into buckets of bounded size, where
    a learned index, fitted shard by shard, finds the neighbours. Entities are carried as two 64-bit hashes and compared by
    both. The answers go back to the query rows by a join that keeps hot entity days off one task.
    """
    spark = queries.sparkSession
    h = [F.xxhash64(*keys).alias("h__"), F.xxhash64(F.lit("second"), *keys).alias("g__")]

    def slim(df: DataFrame, row: str, day: str) -> DataFrame:
        return df.dropna(subset=[*keys, row, day]).select(F.col(row).cast("long").alias("r__"), *h, F.unix_date(F.col(day).cast("date")).alias("d__"))

    q, r = slim(queries, query_id, query_day), slim(records, record_id, record_day)
    b = buckets_for(queries.count() + records.count(), rows_per_bucket, spark)
    shard = lambda d: F.floor(d / F.lit(SHARD_DAYS)).cast("int")
    bucket = F.pmod(F.xxhash64("h__", "s__"), F.lit(b)).alias("b__")
    ask = q.groupBy("h__", "g__", "d__").agg(F.lit(1).alias("one__")).select("h__", "g__", "d__", shard(F.col("d__")).alias("s__"))
    have = r.groupBy("h__", "g__", "d__").agg(F.min("r__").alias("r__"))
    have = have.withColumn("s__", F.explode(F.array_distinct(F.array(*[shard(F.col("d__") + x) for x in (-tolerance, 0, tolerance)]))))
    found = (
        ask.select("h__", "g__", "s__", "d__", bucket)
        .groupBy("b__")
        .cogroup(have.select("h__", "g__", "s__", "d__", "r__", bucket).groupBy("b__"))
        .applyInArrow(_search(tolerance), "h__ long, g__ long, d__ int, r__ long")
    )
    back = skew_join(q.withColumnRenamed("r__", "q__"), found, ["h__", "g__", "d__"])
    return back.select(F.col("q__").alias(query_id), F.col("r__").alias(record_id))
