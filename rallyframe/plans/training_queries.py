"""Queries of the general training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.dates import clean_id, usable_date
from rallyframe.operators.asof import known_at
from rallyframe.operators.rolling import rolling_totals
from rallyframe.operators.skew import lookup_join
from rallyframe.sources.tables import table


def p1_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes of each winner over the trailing 7 and 30 days, on every day of the winner's span."""
    rows = table(spark, sf_dir, "tiny").select(clean_id("winner_id").alias("winner_id"), usable_date("tourney_date").alias("tourney_date"), "minutes")
    return rolling_totals(rows, "winner_id", "tourney_date", "minutes")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tiny").select("row_id", clean_id("winner_id").alias("winner_id"), usable_date("tourney_date").alias("day"), "winner_ht", "winner_age")


def _in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    bio = table(spark, sf_dir, "player_bio").withColumn("player_id", clean_id("player_id"))
    return known_at(_events(spark, sf_dir), bio, "row_id", "winner_id", "day", "player_id", "valid_from", "known_on", "bio_id")


def p7_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result row with the record of its winner in force on its day."""
    return _in_force(spark, sf_dir)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose winner's height or age differs from the record in force on their day."""
    bio = table(spark, sf_dir, "player_bio").select("bio_id", "ht", F.col("birth_date").cast("date").alias("born"))
    rows = lookup_join(_in_force(spark, sf_dir).join(_events(spark, sf_dir), "row_id"), bio, ["bio_id"])
    age = F.datediff("day", "born") / F.lit(365.25)
    wrong_ht = F.coalesce((F.col("winner_ht") != F.col("ht")) & ~F.isnan("winner_ht") & ~F.isnan("ht"), F.lit(False))
    wrong_age = F.coalesce((F.abs(F.col("winner_age") - age) > 0.5) & ~F.isnan("winner_age"), F.lit(False))
    return rows.where(wrong_ht | wrong_age).select("row_id", "bio_id").distinct()


_DAY = "case when regexp_matches(tourney_date, '^[0-9]{8}$') then cast(try_strptime(tourney_date, '%Y%m%d') as date) end"
_ID = "nullif(regexp_replace(trim({}), '\\.0$', ''), '')"

QUERIES = {"p1_rolling": p1_rolling, "p7_in_force": p7_in_force, "p7_found": p7_found}

ORACLES = {
    "p1_rolling": f"""
with t as (select {_ID.format("winner_id")} winner_id, {_DAY} d, minutes from tiny),
x as (select winner_id, d, sum(minutes) m from t where winner_id is not null and d is not null group by all),
c as (select winner_id, cast(unnest(generate_series(min(d)::timestamp, max(d)::timestamp, interval 1 day)) as date) d from x group by winner_id),
s as (select c.winner_id, c.d, coalesce(sum(m) over w7, 0) s7, coalesce(sum(m) over w30, 0) s30 from c left join x using (winner_id, d)
      window w7 as (partition by c.winner_id order by c.d rows between 6 preceding and current row),
             w30 as (partition by c.winner_id order by c.d rows between 29 preceding and current row))
select winner_id, d tourney_date, s7::double sum_7d, s30::double sum_30d, s7 / 7.0::double mean_7d, s30 / 30.0::double mean_30d from s""",
    "p7_in_force": f"""
with e as (select row_id, {_ID.format("winner_id")} w, {_DAY} d from tiny),
c as (select row_id, bio_id, row_number() over (partition by row_id order by valid_from desc, known_on desc, bio_id desc) n
      from e join player_bio b on {_ID.format("b.player_id")} = e.w and b.valid_from <= d and b.known_on <= d)
select row_id, bio_id from c where n = 1""",
    "p7_found": f"""
with e as (select row_id, {_ID.format("winner_id")} w, {_DAY} d, winner_ht, winner_age from tiny),
c as (select e.*, b.bio_id, b.ht, b.birth_date, row_number() over (partition by row_id order by valid_from desc, known_on desc, bio_id desc) n
      from e join player_bio b on {_ID.format("b.player_id")} = e.w and b.valid_from <= d and b.known_on <= d)
select row_id, bio_id from c where n = 1 and (winner_ht <> ht or abs(winner_age - date_diff('day', birth_date::date, d) / 365.25::double) > 0.5)""",
}
