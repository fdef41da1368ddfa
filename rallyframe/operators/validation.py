"""Checks of inputs: complete event weeks, sample sizes."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_rows(df: DataFrame, least: int, what: str) -> int:
    """The number of rows; raises if there are fewer than ``least``."""
    n = df.count()
    if n < least:
        raise ValueError(f"{what}: {n} rows, at least {least} are needed")
    return n


def event_weeks(matches: DataFrame) -> DataFrame:
    """Per week and event of level C: ``rows`` and whether it has a final (``has_final``)."""
    rows = matches.where(F.upper("tourney_level") == "C")
    return rows.groupBy("tourney_date", F.coalesce("tourney_id", F.lit("")).alias("tourney_id")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.upper(F.trim("round")) == "F").alias("has_final"))


def validate_weeks(matches: DataFrame, start: date, end: date) -> dict:
    """Counts over the complete weeks from Monday ``start`` to Sunday ``end``; raises ValueError where they are not covered.

    Targets must reach from the first week to the last, and every event of the last week must have a
    final. Everything is counted in two aggregations; the driver sees counts only.
    """
    if start.weekday() != 0 or end.weekday() != 6:
        raise ValueError("weeks run from a Monday to a Sunday")
    last = end - timedelta(days=6)
    if start > last:
        raise ValueError("no complete week")
    target = F.col("is_target")
    week = F.col("tourney_date")
    inside = target & (week >= F.lit(start)) & (week <= F.lit(last))
    c = matches.agg(F.count(F.lit(1)).alias("rows"), F.sum(target.cast("long")).alias("targets"), F.min(F.when(target, week)).alias("first"), F.max(F.when(target, week)).alias("last"), F.min(F.when(target, F.col("proxy_date"))).alias("first_day"), F.max(F.when(target, F.col("proxy_date"))).alias("last_day"), F.sum(inside.cast("long")).alias("inside")).first()
    if not c["targets"]:
        raise ValueError("no target rows")
    if c["last"] < last:
        raise ValueError(f"results end in the week of {c['last']}, before {last}")
    if c["first"] > start:
        raise ValueError(f"results begin in the week of {c['first']}, after {start}")
    w = event_weeks(matches).where(week == F.lit(last)).agg(F.count(F.lit(1)).alias("events"), F.sum((~F.col("has_final")).cast("long")).alias("open")).first()
    if not w["events"]:
        raise ValueError(f"no events in the week of {last}")
    if w["open"]:
        raise ValueError(f"{w['open']} events of the week of {last} have no final")
    if not c["inside"]:
        raise ValueError("no target rows in the weeks")
    return {"rows": c["rows"], "targets": c["targets"], "targets_inside": c["inside"], "events_in_last_week": w["events"], "last_week": last, "first_day": c["first_day"], "last_day": c["last_day"]}
