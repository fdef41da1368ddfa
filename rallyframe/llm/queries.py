"""Queries of the training-data operators, with the SQL of those that SQL can express."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.dates import clean_id, usable_date
from rallyframe.llm.canonical import canonical_copies, canonical_groups, canonical_text
from rallyframe.llm.entity_match import match_quotes, name_keys
from rallyframe.llm.leaks import leaked_items
from rallyframe.llm.mixing import mix
from rallyframe.llm.names import link_names
from rallyframe.llm.nearest_time import nearest_in_time
from rallyframe.llm.pairwise import global_ranks, offence_defence
from rallyframe.llm.text_quality import text_quality
from rallyframe.operators.skew import skew_join, small
from rallyframe.session import stage, stage_table
from rallyframe.sources.tables import table

FORMATTED = ["tourney_name", "round", "winner_name", "loser_name"]
CODES = ["round"]
DELIVERY = ["source_file", "ingested_at"]


SURFACES = ["Hard", "Clay", "Grass"]


def _ranked(spark: SparkSession, sf_dir: str, surfaces: list[str] | None = None) -> DataFrame:
    surface = F.initcap(F.trim("surface"))
    rows = table(spark, sf_dir, "tiny").where(surface.isin(surfaces) if surfaces else surface != "")
    played = ~F.coalesce(F.upper("score").contains("W/O"), F.lit(False))
    seen = rows.select(surface.alias("surface"), clean_id("winner_id").alias("winner"), clean_id("loser_id").alias("loser"), "tourney_id", canonical_text("round", code=True).alias("round"), played.alias("played"))
    once = seen.groupBy("surface", "winner", "loser", "tourney_id", "round").agg(F.max(F.col("played").cast("int")).alias("played"))
    found = offence_defence(once, "surface", "winner", "loser", weight="played")
    return global_ranks(found.withColumnRenamed("item", "player_id"), "surface", "strength", "player_id")


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength and rank of every player on each surface (all labels, trimmed, in any case; a null label is none).

    Results sent more than once count once. Walkovers are no comparisons; their players are ranked all the same.
    """
    return _ranked(spark, sf_dir).select("surface", "player_id", "wins", "losses", F.round("strength", 6).alias("strength"), "rank", "converged")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest players on each of SURFACES."""
    return _ranked(spark, sf_dir, SURFACES).where("rank <= 5").select("surface", "player_id")


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "player_bio").select(clean_id("player_id").alias("player_id"), F.col("player_name").alias("name"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each spelling that is not the registered name of the player it means, with the player."""
    odds, tiny = table(spark, sf_dir, "odds_template"), table(spark, sf_dir, "tiny")
    typed = odds.select(F.col("player2").alias("spelling")).union(tiny.select("winner_name")).union(tiny.select("loser_name"))
    people = _people(spark, sf_dir)
    found = link_names(typed, people).select("spelling", "player_id")
    return found.join(people.select("player_id", F.col("name").alias("spelling")).distinct(), ["player_id", "spelling"], "left_anti").select("spelling", "player_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote with the nearest result of exactly the same two players, within 8 days."""
    pair = lambda a, b: [F.least(a, b).alias("one"), F.greatest(a, b).alias("two")]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    odds = table(spark, sf_dir, "odds_template").where(both("player1", "player2")).select("odds_id", "date", *pair("player1", "player2"))
    tiny = table(spark, sf_dir, "tiny").where(both("winner_name", "loser_name")).select("row_id", usable_date("tourney_date").alias("day"), *pair("winner_name", "loser_name"))
    return nearest_in_time(odds, tiny, "odds_id", "row_id", ["one", "two"], "date", "day", 8).distinct()


#: Rows up to which the table of name keys (two short texts a row) is broadcast, about 20 MB.
KEYED_NAMES = 200_000


def p5_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote that is for a result in tiny, with that result's first row and a confidence.

    All names are read as typed, on both sides, and keyed by what problem 3's operator makes of them;
    no ids of players are used. A result sent again, alike or nearly, is one result: rows that agree
    in players, event, round and score are twins. Rows whose own date is unusable have their event's.
    """
    odds, tiny = table(spark, sf_dir, "odds_template"), table(spark, sf_dir, "tiny")
    surface = F.upper(F.substring(F.trim("surface"), 1, 1))
    surface = F.when(surface.isin("H", "C", "G"), surface)
    quotes = odds.select(F.col("odds_id").alias("id"), F.col("player1").alias("n1"), F.col("player2").alias("n2"), F.col("date").cast("date").alias("day"), F.col("tournament").alias("event"), surface.alias("surface"))
    rows = tiny.select(F.col("row_id").alias("id"), F.col("winner_name").alias("n1"), F.col("loser_name").alias("n2"), "tourney_date", F.col("tourney_name").alias("event"), "surface", "tourney_id", "round", "score")
    typed = quotes.select("n1", "n2").unionByName(rows.select("n1", "n2")).select(F.explode(F.array("n1", "n2")).alias("spelling"))
    keys = name_keys(typed, _people(spark, sf_dir))
    few = keys.limit(KEYED_NAMES + 1).count() <= KEYED_NAMES

    def keyed(df: DataFrame) -> DataFrame:
        for n, k in (("n1", "k1"), ("n2", "k2")):
            names = keys.select(F.col("spelling").alias(n), F.col("key").alias(k))
            df = df.join(F.broadcast(names), n, "left") if few else skew_join(df, names, [n], "left")
        return df.drop("n1", "n2")

    date = usable_date("tourney_date")
    undated = small(rows.where(date.isNull() & F.col("tourney_id").isNotNull()).select("tourney_id").distinct())
    days = rows.select("tourney_id", "tourney_date").join(undated, "tourney_id", "left_semi").groupBy("tourney_id").agg(F.min(date).alias("event_day"))
    days = small(stage(days))

    def finished(df: DataFrame) -> DataFrame:
        df = keyed(df).join(days, "tourney_id", "left").withColumn("day", F.coalesce(date, "event_day"))
        where = F.coalesce(F.col("tourney_id"), F.concat(F.lit("~"), F.coalesce("event", F.lit("")), F.lit("~"), F.coalesce(F.col("day").cast("string"), F.lit(""))))
        same = [F.translate(F.upper("round"), string.punctuation + string.whitespace, ""), F.coalesce("score", F.lit(""))]
        return df.select("id", "k1", "k2", "day", "event", surface.alias("surface"), F.xxhash64(where, *same, F.least("k1", "k2"), F.greatest("k1", "k2")).alias("twin"))

    found = match_quotes(keyed(quotes), stage_table(finished(rows)))
    return found.select(F.col("l").alias("odds_id"), F.col("r").alias("row_id"), "confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quote that is for a result in tiny, with that result's first row."""
    return p5_matches(spark, sf_dir).select("odds_id", "row_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each result row that repeats another but for formatting, with the first of its copies."""
    return canonical_copies(table(spark, sf_dir, "tiny"), "row_id", FORMATTED, DELIVERY, CODES).distinct()


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct result once, with the number of its copies."""
    return canonical_groups(table(spark, sf_dir, "tiny"), "row_id", FORMATTED, DELIVERY, CODES)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding at least 12 consecutive words of an evaluation item."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), exact=True)
    return found.select("doc_id", "item_id")


def p8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents holding 12 words close to 12 of an evaluation item, with the similarity."""
    found = leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is drawn for the wanted mix of sources."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of all tokens that the sources reach."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_weights"))[1]


def p10_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text statistics of each document."""
    return text_quality(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural prose."""
    return text_quality(table(spark, sf_dir, "documents")).where("2 * junk_line_share > 1").select("doc_id").distinct()


QUERIES = {"p2_found": p2_found, "p2_ranking": p2_ranking, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_matches": p5_matches, "p6_found": p6_found, "p6_records": p6_records, "p8_found": p8_found, "p8_near": p8_near, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_stats": p10_stats}

_DAY = "case when regexp_matches(tourney_date, '^[0-9]{8}$') then cast(try_strptime(tourney_date, '%Y%m%d') as date) end"
_PLAIN = "translate(lower({0}), '''’‘`´ʼ', '')"
# Word order set aside: sorted words. In round a gap may stand between any two characters, so their order is set aside.
_SORTED = "array_to_string(list_sort(regexp_split_to_array(regexp_replace(" + _PLAIN + ", '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g'), ' ')), '')"
_LETTERS = "array_to_string(list_sort(string_split(regexp_replace(" + _PLAIN + ", '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', '', 'g'), '')), '')"
_REST = """tourney_id, surface, draw_size, tourney_level, indoor, tourney_date, match_num, winner_id, winner_seed, winner_entry, winner_hand, winner_ht, winner_ioc,
winner_age, loser_id, loser_seed, loser_entry, loser_hand, loser_ht, loser_ioc, loser_age, score, best_of, minutes, w_ace, w_df, w_svpt, w_1stin, w_1stwon, w_2ndwon,
w_svgms, w_bpsaved, w_bpfaced, l_ace, l_df, l_svpt, l_1stin, l_1stwon, l_2ndwon, l_svgms, l_bpsaved, l_bpfaced, winner_rank, winner_rank_points, loser_rank, loser_rank_points"""
_COPIES = f"select *, min(row_id) over g f, count(*) over g n from (select *, {_SORTED.format('tourney_name')} c1, {_LETTERS.format('round')} c2, {_SORTED.format('winner_name')} c3, {_SORTED.format('loser_name')} c4 from tiny) window g as (partition by c1, c2, c3, c4, {_REST})"

_ID = "nullif(regexp_replace(trim({}), '\\.0$', ''), '')"
#: Iterations of the plain form of problem 2: far beyond where its strengths settle.
_ROUNDS = 300

ORACLES = {
    "p2_found": f"""
with recursive a as (select upper(left(trim(surface), 1)) || lower(substr(trim(surface), 2)) s, {_ID.format("winner_id")} w, {_ID.format("loser_id")} l, tourney_id t, {_LETTERS.format("round")} r, not coalesce(contains(upper(score), 'W/O'), false) played from tiny),
b as (select s, w, l, t, r, max(played::int) n from a where s in ('Hard', 'Clay', 'Grass') and w <> l group by all),
c as (select s, w, l, sum(n)::double n from b group by all),
e as materialized (select s, w, l, sum(n) n from (select * from c union all select s, w, w, 0 from c union all select s, l, l, 0 from c) group by all),
v as (select 0 i, s, w p, 1::double o, 1::double d from e where w = l
 union all select i, s, p, o, d from (
  with o as (select e.s, e.w p, max(v.i) + 1 i, sum(e.n / v.d) + 2 o from e join v on v.s = e.s and v.p = e.l where v.i < {_ROUNDS} group by e.s, e.w)
  select o.i, o.s, o.p, o.o, x.d from o join (select e.s, e.l p, sum(e.n / o.o) + 2 d from e join o on o.s = e.s and o.p = e.w group by e.s, e.l) x on x.s = o.s and x.p = o.p))
select s surface, p player_id from v where i = {_ROUNDS} qualify row_number() over (partition by s order by o / d desc, p) <= 5""",
    "p4_found": f"""
with t as (select row_id, {_DAY} d, least(winner_name, loser_name) a, greatest(winner_name, loser_name) b from tiny where winner_name is not null and loser_name is not null),
c as (select odds_id, row_id, row_number() over (partition by odds_id order by abs(date_diff('day', o.date::date, t.d)), t.d, row_id) n
      from odds_template o join t on least(player1, player2) = a and greatest(player1, player2) = b and player1 is not null and player2 is not null
      and abs(date_diff('day', o.date::date, t.d)) <= 8)
select odds_id, row_id from c where n = 1""",
    "p6_found": f"select f first_row_id, row_id copy_row_id from ({_COPIES}) where row_id <> f",
    "p6_records": f"select row_id first_row_id, n copies from ({_COPIES}) where row_id = f",
    "p8_found": r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') w from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') w from eval_items),
dw as (select distinct doc_id, array_to_string(w[k : k + 11], ' ') s from (select doc_id, w, unnest(generate_series(1, len(w) - 11)) k from d)),
iw as (select distinct item_id, array_to_string(w[k : k + 11], ' ') s from (select item_id, w, unnest(generate_series(1, len(w) - 11)) k from i))
select distinct doc_id, item_id from dw join iw using (s)""",
}
