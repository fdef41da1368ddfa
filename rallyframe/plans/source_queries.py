"""Queries of sources, sinks and streams: the tables are written in the source's form, read back by its operator, and checked by SQL over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.operators import models
from rallyframe.operators.features import FEATURES
from rallyframe.plans import match_queries as mq
from rallyframe.session import checkpoint_dir, stage_table
from rallyframe.sources import pages
from rallyframe.sources.results import BY_LEVEL, BY_TOUR, read_results, read_results_folder
from rallyframe.sources.sinks import append_new
from rallyframe.sources.tables import table
from rallyframe.streaming.rolling import activity


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared store, deleted when the application ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/source-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


#: Names keep their blanks in the files, as typed.
_KEPT = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _kind() -> Column:
    f = F.col("source_file")
    return F.when(f.contains("challenger"), 1).when(f.contains("futures"), 2).otherwise(0)


def _written(spark: SparkSession, sf_dir: str, layout: tuple) -> tuple[str, list[int]]:
    """The raw results as files of a layout: one per year (the first four characters of the date) and kind."""
    root = _folder(spark)
    year = F.substring("tourney_date", 1, 4)
    rows = table(spark, sf_dir, "tiny").withColumns({"y__": F.when(year.rlike("^[0-9]{4}$"), year.cast("int")), "k__": _kind()}).where("y__ is not null").drop("source_file", "ingested_at")
    rows = rows.persist()
    found = sorted((r[0], r[1]) for r in rows.select("y__", "k__").distinct().collect())  # one row per year and kind
    for y, k in found:
        rows.where((F.col("y__") == y) & (F.col("k__") == k)).drop("y__", "k__").write.csv(f"{root}/{layout[k][1].format(year=y)}", header=True, **_KEPT)
    rows.unpersist()
    return root, sorted({y for y, _ in found})


def m_results_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A results file read as canonical matches."""
    root = _folder(spark)
    table(spark, sf_dir, "tiny").drop("source_file", "ingested_at").write.csv(f"{root}/all.csv", header=True, **_KEPT)
    return read_results(spark, f"{root}/all.csv", "main", multi_line=True).groupBy("tourney_date", "tourney_id", "round", "winner_key", "loser_key").agg(F.count(F.lit(1)).alias("n"))


def _folder_rows(spark: SparkSession, sf_dir: str, layout: tuple, identity: list[str]) -> DataFrame:
    root, years = _written(spark, sf_dir, layout)
    return read_results_folder(spark, root, years, layout, multi_line=True).select(*identity, "source_kind", F.year("tourney_date").alias("year"))


BY_KEY = ["tourney_id", "tourney_date", "round", "winner_key", "loser_key"]
BY_NAME = ["tourney_name", "tourney_date", "round", "winner_name", "loser_name"]


def m_results_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files of results by level, each match once, by its keys."""
    return _folder_rows(spark, sf_dir, BY_LEVEL, BY_KEY)


def m_results_by_tour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly files of results by tour, each match once, by its names."""
    return _folder_rows(spark, sf_dir, BY_TOUR, BY_NAME)


def _escaped(c: str) -> Column:
    out = F.coalesce(F.col(c), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day page per quote: its event as the header, its players in two rows."""
    odd = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("."), F.lit(",")), F.lit(""))
    html = F.concat(
        F.lit('<table class="result"><tr class="head flags"><td class="t-name">'), _escaped("tournament"), F.lit(' <a>Challenger</a></td></tr><tr id="m1" class="one"><td class="time">'), F.date_format("start_time", "HH:mm"),
        F.lit('</td><td class="t-name"><a>'), _escaped("player1"), F.lit('</a> (3)</td><td class="course">'), odd("odd1"), F.lit('</td><td class="course">'), odd("odd2"), F.lit('</td><td><a href="/match-detail/?id='), F.col("odds_id").cast("string"),
        F.lit('">x</a></td></tr><tr id="m1b" class="one"><td class="t-name">'), _escaped("player2"), F.lit("</td></tr></table>"),
    )
    return table(spark, sf_dir, "odds_template").select(F.col("odds_id").alias("page_id"), F.col("date").cast("date").alias("date"), html.alias("html"), F.concat(F.lit("/"), F.col("source")).alias("url"))


def m_day_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches of stored day pages."""
    found = pages.extract_day_quotes(_pages(spark, sf_dir))
    return found.select("page_id", "date", "time", "player1", "player2", "odd1", "odd2", F.round("implied_sum", 6).alias("implied_sum"), F.col("valid_price_pair").cast("long").alias("valid_price_pair"), "match_url")


def m_book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing and opening quotes of two bookmakers from stored match pages."""
    odd = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    cell = lambda k, now, then: F.concat(F.lit(f'<td class="k{k}"><div class="odds-in">'), odd(now), F.lit("<div><table><tr><td>now</td><td>1</td></tr><tr><td>Opening odds</td></tr><tr><td>then</td><td>"), odd(then), F.lit("</td></tr></table></div></div></td>"))
    html = F.concat(F.lit("<table><tr><td><a>One</a></td>"), cell(1, "odd1", "odd2"), cell(2, "odd2", "odd1"), F.lit("</tr></table>"))
    rows = table(spark, sf_dir, "odds_template").select(F.col("odds_id").alias("page_id"), html.alias("html"))
    return pages.extract_book_quotes(rows, ("One", "Two")).select("page_id", "book", F.col("present").cast("long").alias("present"), "close1", "close2", "open1", "open2", "close_time1", "open_time2")


def m_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stored page of each address."""
    return pages.first_pages(_pages(spark, sf_dir).select("page_id", "url")).select("page_id", "url")


def m_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days from the first quote to the last."""
    low, high = table(spark, sf_dir, "odds_template").agg(F.min(F.col("date").cast("date")), F.max(F.col("date").cast("date"))).first()
    return pages.days_between(spark, low, high)


def m_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table appended to twice, the second time with all rows: each key stands once."""
    path = f"{_folder(spark)}/quotes"
    rows = table(spark, sf_dir, "odds_template").select("odds_id", "source", "odd1")
    for part in (rows.where("odds_id % 3 = 0"), rows, rows):
        append_new(part, path, ["odds_id"])
    return spark.read.parquet(path).groupBy("odds_id", "source").agg(F.count(F.lit(1)).alias("n"))


def m_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes per source over sliding weeks, by the streaming operator on the table."""
    rows = table(spark, sf_dir, "odds_template").select(F.col("start_time").alias("ts"), "source", F.when(F.col("odd1") > 1, F.col("odd1")).alias("v")).where("ts is not null")
    found = activity(rows, "ts", "source", "v")
    return found.select(F.col("start").cast("date").alias("start"), "source", "n", F.round("total", 4).alias("total"))


def _feature_rows(spark: SparkSession, sf_dir: str, more: tuple[str, ...] = ()) -> DataFrame:
    """The feature rows, staged with all features and ``more``."""
    return stage_table(mq.features(spark, sf_dir, ["row_id", "date", "target", *FEATURES, *more]), free=True)


def m_horizons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lengths of training compared by the walk-forward scores of all five models on all features."""
    _, rows = models.compare_horizons(_feature_rows(spark, sf_dir), [365, 730])
    return mq._six(spark.createDataFrame([(r["horizon_days"], r["n"], r["log_loss"], r["brier"], r["fold_log_loss_std"], r["selection_score"]) for r in rows], "horizon_days long, n long, log_loss double, brier double, fold_log_loss_std double, selection_score double"))


def m_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last half year scored by an ensemble of all five models on all features, fitted before it."""
    rows = _feature_rows(spark, sf_dir)
    cutoff = rows.agg(F.date_sub(F.max("date"), 180)).first()[0]
    oof = models.walk_forward(rows, 365)
    final = models.fit_final(rows, oof, 365, cutoff)
    return mq._six(final.predict(rows.where(F.col("date") >= F.lit(cutoff))).select("row_id", "ensemble_raw", "predicted_probability", "ensemble_dispersion", "reliability"))


def m_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked matches scored by an offset model on the quotes' probability, fold by fold."""
    oof = models.walk_forward(_feature_rows(spark, sf_dir, ("event_start_date", "tourney_name", "player_a", "player_b")), 365)
    from rallyframe.operators.linking import link_exact

    linked = link_exact(oof, mq._quotes(spark, sf_dir))[0]
    gaps = stage_table(models.with_reference_gaps(linked))
    found = models.walk_forward_offset(gaps, models.OFFSET_FEATURES, "market_logit_a", "market_probability_a")
    return mq._six(found.select("row_id", "fold_id", "market_probability_a", "value_probability"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("m_")}



def _files(keys: list[str], kinds: str) -> str:
    """Canonical matches in the order of their files, by year and kind, the first of each identity."""
    kind = "case when contains(source_file, 'challenger') then 1 when contains(source_file, 'futures') then 2 else 0 end"
    return f"""with {mq._CANON}, y as (select *, year(tourney_date) yr, {kind} k from c)
select {", ".join(keys)}, {kinds} source_kind, yr as year from y qualify row_number() over (partition by {", ".join(keys)} order by yr, k, round_order, match_num, winner_key, loser_key) = 1"""


ORACLES = {
    "m_results_file": f"with {mq._CANON} select tourney_date, tourney_id, round, winner_key, loser_key, count(*) n from c group by all",
    "m_results_by_level": _files(BY_KEY, "case k when 0 then 'main' when 1 then 'qual_chall' else 'futures' end"),
    "m_results_by_tour": _files(BY_NAME, "case k when 0 then 'main' when 1 then 'challenger' else 'tour_qual' end"),
    "m_day_pages": """
with o as (select odds_id, date::date d, strftime(start_time, '%H:%M') t, regexp_replace(player1, '^\\s+|\\s+$', '', 'g') a, regexp_replace(player2, '^\\s+|\\s+$', '', 'g') b, case when odd1 > 1 then odd1 end x, case when odd2 > 1 then odd2 end y from odds_template where player1 is not null and player2 is not null and start_time is not null and date is not null),
p as (select *, coalesce(x, y) p1, case when x is not null then y end p2 from o), i as (select *, 1 / p1 + 1 / p2 s from p)
select odds_id page_id, d date, t "time", a player1, b player2, p1 odd1, p2 odd2, round(s, 6) implied_sum, coalesce(s >= 0.94::double and s <= 1.2::double, false)::bigint valid_price_pair, '/match-detail/?id=' || odds_id match_url from i""",
    "m_book_pages": """
with o as (select odds_id, case when odd1 > 1 then odd1 end x, case when odd2 > 1 then odd2 end y from odds_template)
select odds_id page_id, 'One' book, 1::bigint present, x close1, y close2, y open1, x open2, 'now' close_time1, 'then' open_time2 from o
union all select odds_id, 'Two', 0, null, null, null, null, null, null from o""",
    "m_first_pages": "select min(odds_id) page_id, '/' || source url from odds_template group by source",
    "m_days": "select cast(unnest(generate_series(min(date::date)::timestamp, max(date::date)::timestamp, interval 1 day)) as date) \"day\" from odds_template",
    "m_append": "select odds_id, source, count(*) n from odds_template group by all",
    "m_activity": """
with o as (select date_trunc('day', start_time)::date d, source, case when odd1 > 1 then odd1 end v from odds_template where start_time is not null)
select (d - k::int)::date "start", source, count(*) n, round(sum(v), 4) total from o, range(7) t(k) group by all""",
}
