"""Exact duplicates hidden by formatting: canonical keys, and groups counted without hot tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.operators.skew import hot_keys, hot_table, skew_join
from rallyframe.session import stage

#: Characters that stand inside a word and are dropped rather than splitting it.
APOSTROPHES = "'’‘`´ʼ"
#: Rows that a key needs at least before it can count as hot.
HOT_ROWS = 50_000


def canonical_text(c: str | Column, code: bool = False) -> Column:
    """A text with case, whitespace, punctuation and word order set aside; accents and digits count.

    Runs of letters (with their combining marks) and digits are the words, apostrophes are dropped,
    and the sorted words are joined without gaps, so ``Li, Y.`` and ``y  li`` are one. In a column of
    codes (``code``) a gap may stand anywhere (``R.3.2.`` is ``R32``, ``F S`` is ``SF``), each
    character can be a word, and so the characters themselves are sorted. Null stays null; a text
    without letters or digits becomes the empty text.
    """
    c = F.col(c) if isinstance(c, str) else c
    plain = F.translate(F.lower(c), APOSTROPHES, "")
    parts = F.split(F.regexp_replace(plain, r"[^\p{L}\p{M}\p{N}]+", "" if code else " "), "" if code else " ")
    return F.array_join(F.array_sort(parts), "")


def _exact(df: DataFrame, c: str) -> Column:
    """A column's value as text, null and NaN as one mark, so that null equals null."""
    kind = dict(df.dtypes)[c]
    col = F.col(f"`{c}`")
    if kind in ("double", "float"):
        col = F.when(~F.isnan(col), F.when(col == 0, F.lit(0.0).cast(kind)).otherwise(col))
    return F.coalesce(F.concat(F.lit("="), col.cast("string")), F.lit("~"))


def keyed(df: DataFrame, row_id: str, loose: list[str], ignore: list[str], codes: list[str] | None = None) -> DataFrame:
    """``row_id`` and the 256-bit key of each row (``k__``): canonical ``loose`` columns (``codes`` among them read as codes) and exact others."""
    fixed = [c for c in df.columns if c not in {row_id, *loose, *ignore}]
    parts = [F.coalesce(F.concat(F.lit("="), canonical_text(c, c in (codes or ()))), F.lit("~")) for c in loose] + [_exact(df, c) for c in fixed]
    return df.select(F.col(row_id).alias("i__"), F.unhex(F.sha2(F.concat_ws("\x1f", *parts), 256)).alias("k__"))


def _counts(rows: DataFrame, hot: dict[tuple, int]) -> DataFrame:
    """Copies and smallest id by key: hot keys in two levels over salts, the rest in one shuffle."""
    one = [F.min("i__").alias("first__"), F.count(F.lit(1)).alias("n__")]
    if not hot:
        return rows.groupBy("k__").agg(*one)
    marked = rows.join(hot_table(rows, ["k__"], hot), "k__", "left")
    salted = marked.where("salts__ is not null").groupBy("k__", F.pmod(F.xxhash64("i__"), F.col("salts__")).alias("s__")).agg(*one)
    top = salted.groupBy("k__").agg(F.min("first__").alias("first__"), F.sum("n__").alias("n__"))
    return top.unionByName(marked.where("salts__ is null").groupBy("k__").agg(*one))


def canonical_groups(df: DataFrame, row_id: str, loose: list[str], ignore: list[str], codes: list[str] | None = None) -> DataFrame:
    """One row per distinct record: ``first_row_id`` (its smallest id) and ``copies`` (how many rows).

    Records are equal if their ``loose`` columns are equal after ``canonical_text`` (those in
    ``codes`` read as codes) and all others, but ``row_id`` and ``ignore``, are equal (null equals
    null, NaN counts as null, 0.0 as -0.0). Only a row's key, 32 bytes, is shuffled. An empty table
    gives no rows; rows repeated under one id count as copies; very long texts and nulls are keyed
    like any other value.
    """
    rows = stage(keyed(df, row_id, loose, ignore, codes))
    hot = hot_keys(rows, ["k__"], at_least=HOT_ROWS)
    return _counts(rows, hot).select(F.col("first__").alias("first_row_id"), F.col("n__").alias("copies"))


def canonical_copies(df: DataFrame, row_id: str, loose: list[str], ignore: list[str], codes: list[str] | None = None) -> DataFrame:
    """One row per copy: ``first_row_id`` (the group's smallest id) and ``copy_row_id`` (another id).

    Groups are those of ``canonical_groups``. The rows of a hot group meet its representative over
    salts; all others in one shuffle. A row repeated under its own id gives no pair.
    """
    rows = stage(keyed(df, row_id, loose, ignore, codes))
    hot = hot_keys(rows, ["k__"], at_least=HOT_ROWS)
    first = _counts(rows, hot).where("n__ > 1").select("k__", "first__")
    return skew_join(rows, first, ["k__"], hot=hot).where("i__ <> first__").select(F.col("first__").alias("first_row_id"), F.col("i__").alias("copy_row_id"))
