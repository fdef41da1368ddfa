"""Queries of the match operators over the results, quotes and slate, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.names import normalize_name
from rallyframe.functions.scalars import match_rates, month, score_shares
from rallyframe.operators import features as feat
from rallyframe.operators import linking, metrics, models, selection
from rallyframe.operators.history import decayed_means, head_to_head, last_known, past_counts, player_rows
from rallyframe.operators.matches import ORDER, canonical_matches, keep_first, main_draw_targets, rounds_by_event
from rallyframe.operators.ratings import pre_match_ratings
from rallyframe.operators.validation import event_weeks
from rallyframe.plans import feature_sql
from rallyframe.session import checkpoint_dir, stage, stage_table
from rallyframe.sources.results import canonical_quotes
from rallyframe.sources.sinks import systematic_sample
from rallyframe.sources.tables import table


def _kind() -> Column:
    f = F.col("source_file")
    return F.when(f.contains("challenger"), "challenger").when(f.contains("futures"), "futures").otherwise("main")


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_matches(table(spark, sf_dir, "tiny"), _kind(), keep=("row_id",))


def _once(spark: SparkSession, sf_dir: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """Canonical matches, each event's pairing in a round once; with ``columns`` those only, besides the ones that tell which is first."""
    identity, order = ["tourney_id", "tourney_date", "round", "winner_key", "loser_key"], [*ORDER[:3], "row_id"]
    matches = canonical(spark, sf_dir)
    return keep_first(matches.select(*dict.fromkeys([*identity, *order, *columns])) if columns else matches, identity, order)


def _six(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _four(df: DataFrame) -> DataFrame:
    """Doubles to four digits, a little off the half: sums of powers of two lie on halves, and two engines' last bits differ."""
    return df.select(*[F.round(F.col(c) + F.lit(feature_sql.NUDGE), 4).alias(c) if c in feat.FEATURES else F.col(c) for c in df.columns])


def m_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw results in the canonical schema."""
    cols = ["row_id", "source_kind", "tourney_id", "surface", "indoor_known", "indoor_flag", "tourney_level", "level_role", "tourney_date", "proxy_date", "round", "round_order", "match_num", "best_of", "winner_key", "loser_key", "winner_rank", "loser_ht", "w_svpt", "is_retirement", "is_walkover", "is_clean", "is_target"]
    return canonical(spark, sf_dir).select(*cols)


def m_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct name with its normalized form."""
    names = table(spark, sf_dir, "tiny").select(F.col("winner_name").alias("name")).union(table(spark, sf_dir, "tiny").select("loser_name")).dropna().distinct()
    return names.withColumn("normalized", normalize_name("name"))


def m_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each match identity."""
    return _once(spark, sf_dir).select("row_id", "tourney_id", "round", "winner_key", "loser_key")


def m_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by kind of source and level."""
    return canonical(spark, sf_dir).groupBy("source_kind", "level_role").agg(F.count(F.lit(1)).alias("n"))


def m_score_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner's shares of sets and games."""
    sets, games = score_shares("score")
    return _six(table(spark, sf_dir, "tiny").select("row_id", sets.alias("set_share"), games.alias("game_share")))


def m_match_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serve, return, hold and break rates of both sides."""
    rates = match_rates()
    return _six(canonical(spark, sf_dir).select("row_id", *[rates[f"{p}_{r}"].alias(f"{p}_{r}") for p in ("w", "l") for r in ("spw", "rpw", "hold", "break")]))


def _players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return player_rows(_once(spark, sf_dir))


def m_past_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's experience, workload and rest before each match."""
    return past_counts(_players(spark, sf_dir)).select("row_id", "side", "player", "experience", "surface_experience", "rest_days", "workload_7d", "workload_14d", "workload_28d")


def m_last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's rank and points, carried forward from earlier matches where missing."""
    return last_known(_players(spark, sf_dir), ("rank", "points")).select("row_id", "side", "player", "rank", "points")


def m_head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier meetings of the two players of each match."""
    return head_to_head(_once(spark, sf_dir))


def m_decayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed means over each player's last matches: wins, serve points won, wins on the surface kinds."""
    won, yes = F.col("won"), F.lit(True)
    decays = {"win_35": (won, yes, 35), "win_90": (won, yes, 90), "spw_90": (F.col("spw"), yes, 90), "win_clay_180": (won, F.col("surface") == "Clay", 180)}
    out = decayed_means(_players(spark, sf_dir), decays)
    return _six(out.select("row_id", "side", "player", *[c for d in decays for c in (d, f"{d}_n")]))


def m_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' ratings before each match, days in batches."""
    return _six(pre_match_ratings(_once(spark, sf_dir)), 3)


def m_ratings_by_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' ratings before each match, match by match."""
    return _six(pre_match_ratings(_once(spark, sf_dir), replay="row"), 3)


#: Columns of canonical matches that no feature reads.
_UNREAD = {"source_file", "source_kind", "tourney_level", "winner_id", "loser_id", "minutes", "is_retirement", "is_walkover", *[f"{p}_{c}" for p in "wl" for c in ("ace", "df", "1stin")]}


#: Columns of canonical matches that some features or columns read, and those.
_READ = {
    "score": {"set_share_90_diff", "game_share_90_diff"}, "best_of": {"best_of_5"}, "indoor_flag": {"indoor_flag"}, "indoor_known": {"indoor_known"}, "tourney_name": {"tourney_name"},
    **{f"{s}_{c}": x for s in ("winner", "loser") for c, x in {"age": {"age_diff_10"}, "ht": {"height_diff_10"}, "rank_points": {"points_log_diff"}, "entry": {f"entry_{e}_diff" for e in ("q", "wc", "ll", "pr")}, "name": {"player_a", "player_b", "winner_name", "loser_name"}}.items()},
}


def features(spark: SparkSession, sf_dir: str, only: list[str] | None = None) -> DataFrame:
    """The feature row of each target match; with ``only`` these columns, from the columns of matches that they need."""
    spare = _UNREAD | {c for c, x in _READ.items() if only is not None and not x & set(only)}
    columns = tuple(c for c in canonical(spark, sf_dir).columns if c not in spare)
    return _four(feat.build_features(stage_table(_once(spark, sf_dir, columns), free=True), only=only))


def m_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature row of each target match."""
    return features(spark, sf_dir)


def m_mirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows in both orientations."""
    return feat.augment_symmetric(m_features(spark, sf_dir))


def m_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of unplayed fixtures."""
    return _four(feat.live_features(stage(_once(spark, sf_dir)), table(spark, sf_dir, "live_slate_template")))


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("winner_key") < F.col("loser_key")
    m = _once(spark, sf_dir, ("proxy_date", "tourney_name", "winner_name", "loser_name"))
    return m.select("row_id", F.col("tourney_date").alias("event_start_date"), F.col("proxy_date").alias("date"), "tourney_name", F.when(first, F.col("winner_name")).otherwise(F.col("loser_name")).alias("player_a"), F.when(first, F.col("loser_name")).otherwise(F.col("winner_name")).alias("player_b"))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_quotes(table(spark, sf_dir, "odds_template"))


def m_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable quotes in one schema."""
    return _quotes(spark, sf_dir).select("odds_id", "date", "odd1", "odd2", "surface", "player1_key_name", "player2_key_name")


def m_link_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of quotes linked by exact normalized pair and nearest date."""
    return linking.link_exact(_sides(spark, sf_dir), _quotes(spark, sf_dir))[1].select("row_id", "status", "gap")


def m_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the quote linked to them."""
    return _six(linking.link_exact(_sides(spark, sf_dir), _quotes(spark, sf_dir))[0])


def m_linked_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches with the quote linked to them, ties of days decided by equal event names."""
    found = linking.link_exact(_sides(spark, sf_dir), _quotes(spark, sf_dir), events="equal")[0]
    return _six(found.select("row_id", "odds_id", "odds_date_gap", "odds_event_similarity", "odd_a", "odd_b", "market_probability_a", "market_logit_a"))


def m_link_signatures_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of quotes linked by surname and initial, ties of days decided by equal event names."""
    return linking.link_signatures(_sides(spark, sf_dir), _quotes(spark, sf_dir), events="equal")[1].select("row_id", "status", "odds_id", "gap", "reuse")


def m_link_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of quotes linked by surname and initial."""
    return linking.link_signatures(_sides(spark, sf_dir), _quotes(spark, sf_dir))[1].select("row_id", "status", "gap", "reuse")


def _anchors(spark: SparkSession, sf_dir: str, weights: linking.AnchorWeights) -> DataFrame:
    audit = linking.link_anchors(_sides(spark, sf_dir), _quotes(spark, sf_dir), weights=weights)[1]
    return _six(audit.select("row_id", "status", "odds_id", "gap", "pair_score", "total", "margin", "candidates", "tier"))


def m_link_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of quotes linked by surname anchors."""
    return _anchors(spark, sf_dir, linking.NARROW)


def m_link_anchors_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of quotes linked by surname anchors, then by day and event."""
    return _anchors(spark, sf_dir, linking.WIDE)


def m_link_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the links with their typical day gaps."""
    return _six(metrics.quality_summary(m_link_exact(spark, sf_dir), "status", ["gap"]))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.col("winner_key") < F.col("loser_key")
    rank = F.when(first, F.col("loser_rank")).otherwise(F.col("winner_rank")) / (F.col("winner_rank") + F.col("loser_rank"))
    points = F.when(first, F.col("winner_rank_points")).otherwise(F.col("loser_rank_points")) / (F.col("winner_rank_points") + F.col("loser_rank_points"))
    return _once(spark, sf_dir).select("row_id", "tourney_date", "surface", "round", first.cast("int").alias("target"), F.round(rank, 3).alias("p"), F.round(points, 3).alias("p_points"))


def m_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, Brier score, log-loss and AUC of a rank-based probability by surface."""
    return _six(metrics.grouped_metrics(_predicted(spark, sf_dir), ["surface"]))


def m_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same metrics of two probabilities."""
    return _six(metrics.model_metrics(_predicted(spark, sf_dir), ["p", "p_points"]))


def m_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Win rates by decile of the probability."""
    return _six(metrics.calibration_table(_predicted(spark, sf_dir)))


def _edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).where("p is not null").withColumn("gain", F.round(F.col("target") - F.col("p"), 3))


def m_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surprise of results against the probability, over months and per surface."""
    return _six(metrics.period_summary(_edge(spark, sf_dir), ["surface"], month("tourney_date"), "gain"))


def m_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by band of the probability."""
    band = metrics.bands("p", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0])
    return _six(_edge(spark, sf_dir).groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("win_rate")).where("band is not null"))


def m_largest_fall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest fall of the running sum of surprises, per surface."""
    return _six(metrics.largest_fall(_edge(spark, sf_dir), ["surface"], ["tourney_date", "row_id"], "gain", "tourney_date"))


def m_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An interval of the mean surprise."""
    return _six(metrics.bootstrap_mean(_edge(spark, sf_dir), "gain"))


def m_top_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surest tenth of each week's matches."""
    return selection.top_fraction(_edge(spark, sf_dir), "tourney_date", [F.desc("p"), F.asc("row_id")], 0.1).select("row_id", "tourney_date", "p", "place", "cap")


def m_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean surprise of the surest matches under a grid of fractions and floors, in one job."""
    grid = spark.createDataFrame([(f"{f}/{x}", f, x) for f in (0.05, 0.1, 0.25) for x in (0.5, 0.7)], "policy string, fraction double, floor double")
    chosen = selection.grid_top_fraction(_edge(spark, sf_dir), "tourney_date", [F.desc("p"), F.asc("row_id")], grid, F.col("p") >= F.col("floor"))
    return _six(chosen.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("gain").alias("mean_gain")))


def m_grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid's selections summed up over months, in one job."""
    grid = spark.createDataFrame([(f"{f}/{x}", f, x) for f in (0.05, 0.1, 0.25) for x in (0.5, 0.7)], "policy string, fraction double, floor double")
    return _six(selection.grid_summary(_edge(spark, sf_dir), "tourney_date", [F.desc("p"), F.asc("row_id")], grid, F.col("p") >= F.col("floor"), month("tourney_date"), "gain"))


def m_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored selection, read back and applied."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/selection-{uuid.uuid4().hex}"
    selection.Selection("tenth", "tourney_date", 0.1, ("-p", "row_id"), {"p": 0.6}, {"gain": 0.3}).save(spark, path)
    return selection.Selection.load(spark, path).apply(_edge(spark, sf_dir)).select("row_id", "tourney_date", "place", "cap")


def m_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best grid row that has enough rows, else the one with most."""
    return selection.choose(m_grid(spark, sf_dir), [(F.col("n") >= 100, [F.desc("mean_gain"), F.asc("policy")]), (F.lit(True), [F.desc("n"), F.asc("policy")])])


def m_event_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per week and event of level C its rows and whether it has a final."""
    return event_weeks(canonical(spark, sf_dir))


def m_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target matches by round before and after qualifying rounds are set aside."""
    before = canonical(spark, sf_dir)
    both = before.select("round", "is_target", F.lit(0).alias("after")).union(main_draw_targets(before).select("round", "is_target", F.lit(1)))
    return both.groupBy("round").agg(F.sum((F.col("is_target") & (F.col("after") == 0)).cast("long")).alias("before"), F.sum((F.col("is_target") & (F.col("after") == 1)).cast("long")).alias("after"))


def m_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounds of each event."""
    return rounds_by_event(canonical(spark, sf_dir)).withColumn("rounds", F.array_join("rounds", ","))


def m_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth result in order: a systematic sample."""
    return systematic_sample(table(spark, sf_dir, "tiny").select("row_id", "tourney_id"), ["row_id"], 10)


def m_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities of all five models on all features, each fold of 28 days fitted on the year before it."""
    oof = models.walk_forward(stage_table(features(spark, sf_dir, ["row_id", "date", "target", *feat.FEATURES]), free=True), 365)
    return _six(oof.select("row_id", "fold_id", "target", *[c for c in oof.columns if c.startswith("p_")], "ensemble_raw", "predicted_probability", "ensemble_dispersion", "reliability"))


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("m_")}

_KIND = "case when contains(source_file, 'challenger') then 'challenger' when contains(source_file, 'futures') then 'futures' else 'main' end"
_NORM = r"trim(regexp_replace(trim(regexp_replace(replace(lower(strip_accents({0})), '’', ''''), '\b(jr|sr)\.?$', '')), '[^a-z0-9]+', ' ', 'g'))"
_KEY = "coalesce(case when nullif(regexp_replace(trim({0}_id), '\\.0$', ''), '') not in ('nan', 'None') then nullif(regexp_replace(trim({0}_id), '\\.0$', ''), '') end, 'name:' || " + _NORM.format("{0}_name") + ")"
_RO = "case rd when 'Q1' then 0 when 'Q2' then 1 when 'Q3' then 2 when 'Q4' then 3 when 'R128' then 4 when 'R64' then 5 when 'R32' then 6 when 'R16' then 7 when 'QF' then 8 when 'SF' then 9 when 'F' then 10 when 'RR' then 7 when 'BR' then 11 else 6 end"
_RD = "case trim(rd) when 'Q1' then 0 when 'Q2' then 1 when 'Q3' then 2 when 'Q4' then 3 when 'R128' then 0 when 'R64' then 1 when 'R32' then 2 when 'R16' then 3 when 'QF' then 4 when 'SF' then 5 when 'F' then 6 when 'RR' then 2 when 'BR' then 6 else case when starts_with(trim(rd), 'Q') then 6 else 2 end end"
_CANON = f"""c0 as (select *, upper(coalesce(round, '')) rd, {_KIND} source_kind, upper(coalesce(tourney_level, '')) lv, upper(coalesce(score, '')) sc,
 case when regexp_matches(tourney_date, '^[0-9]{{8}}$') then cast(try_strptime(tourney_date, '%Y%m%d') as date) end d, lower(trim(coalesce(indoor, ''))) ind,
 upper(left(trim(surface), 1)) || lower(substr(trim(surface), 2)) sf, {_KEY.format("winner")} winner_key, {_KEY.format("loser")} loser_key from tiny),
c1 as (select row_id, source_file, source_kind, tourney_id, tourney_name, case when sf in ('Hard', 'Clay', 'Grass', 'Carpet') then sf else 'Unknown' end surface,
 cast(ind in ('yes', 'no', 'true', 'false', '1', '0', 'indoor', 'outdoor') as double) indoor_known, cast(ind in ('yes', 'true', '1', 'indoor') as double) indoor_flag,
 lv tourney_level, case when source_kind = 'challenger' then 'challenger' when source_kind = 'futures' then 'futures' when lv = 'C' then 'challenger' else 'main' end level_role,
 d tourney_date, d + {_RD} proxy_date, rd round, {_RO} round_order, coalesce(match_num, 0) match_num, coalesce(best_of, 3) best_of, winner_key, loser_key, winner_name, loser_name,
 winner_rank, loser_rank, winner_rank_points, loser_rank_points, winner_ht, loser_ht, winner_age, loser_age, upper(coalesce(winner_entry, '')) winner_entry, upper(coalesce(loser_entry, '')) loser_entry, w_svpt, l_svpt, w_1stwon, w_2ndwon, l_1stwon, l_2ndwon, w_bpfaced, w_bpsaved, l_bpfaced, l_bpsaved, w_svgms, l_svgms, score,
 regexp_matches(sc, '\\b(RET|DEF)\\b') is_retirement, regexp_matches(sc, 'W/O|WALKOVER') is_walkover
 from c0 where d is not null and winner_name is not null and loser_name is not null and winner_key <> loser_key),
c as (select *, not (is_retirement or is_walkover) is_clean, (tourney_level = 'C' or level_role = 'challenger') and not (is_retirement or is_walkover) is_target from c1)"""
_ONCE = _CANON + """,
m as (select * from (select *, row_number() over (partition by tourney_id, tourney_date, round, winner_key, loser_key order by round_order, match_num, row_id) rn from c) where rn = 1)"""
_SIDES = _ONCE + """,
p as (select row_id, 'w' side, winner_key player, proxy_date d, tourney_id, round_order, match_num, winner_key, loser_key, surface, is_clean, 1.0::double won, winner_rank rank, winner_rank_points points, (w_1stwon + w_2ndwon) / nullif(w_svpt, 0) spw from m
 union all select row_id, 'l', loser_key, proxy_date, tourney_id, round_order, match_num, winner_key, loser_key, surface, is_clean, 0.0::double, loser_rank, loser_rank_points, (l_1stwon + l_2ndwon) / nullif(l_svpt, 0) from m)"""
_PRED = _ONCE + """,
e as (select row_id, tourney_date, surface, cast(winner_key < loser_key as int) target,
 round(case when winner_key < loser_key then loser_rank else winner_rank end / (winner_rank + loser_rank), 3) p,
 round(case when winner_key < loser_key then winner_rank_points else loser_rank_points end / (winner_rank_points + loser_rank_points), 3) p_points from m)"""
_EDGE = _PRED + ", g as (select *, round(target - p, 3) gain from e where p is not null)"


def _metric(source: str, key: str) -> str:
    return f"""x as (select {key}, target y, greatest(least({{p}}, 1 - 1e-6), 1e-6)::double q from {source} where target is not null and {{p}} is not null),
r as (select *, (rank() over (partition by {key} order by q) + rank() over (partition by {key} order by q) + count(*) over (partition by {key}, q) - 1) / 2.0::double rk from x)
select {key}, count(*) n, round(avg(cast((q >= 0.5) = (y = 1) as int)), 6)::double accuracy, round(avg((y - q) * (y - q)), 6) brier, round(-avg(case when y = 1 then ln(q) else ln(1 - q) end), 6) log_loss,
 round(case when sum(y) > 0 and sum(1 - y) > 0 then (sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y) * sum(1 - y))::double end, 6) auc from r group by {key}"""


def _decay(name: str, value: str, test: str, half: int) -> str:
    w = f"pow(2::double, -(r.d - o.d) / {half}::double)"
    ok = f"({test}) and {value} is not null"
    return f"round(sum(case when {ok} then {w} * {value} end) / sum(case when {ok} then {w} end), 6) {name}, round(coalesce(sum(case when {ok} then {w} end), 0), 6) {name}_n"


_LINK = f"""{_ONCE}, f as (select row_id, tourney_date d, tourney_name ev, case when winner_key < loser_key then winner_name else loser_name end a, case when winner_key < loser_key then loser_name else winner_name end b from m),
fn as (select *, {_NORM.format("a")} na, {_NORM.format("b")} nb, {_NORM.format("coalesce(ev, '')")} ne from f),
qn as (select odds_id, date::date d, odd1, odd2, {_NORM.format("coalesce(player1, '')")} n1, {_NORM.format("coalesce(player2, '')")} n2, {_NORM.format("coalesce(tournament, '')")} ne from odds_template where date is not null and odd1 > 1 and odd2 > 1)"""
_SAME_EVENT = "(f.ne <> '' and f.ne = q.ne)::double"
_SUFFIXES = "(with w as (select list_filter(string_split({0}, ' '), lambda x: x <> '') l) select list_distinct(list_transform(range(greatest(len(l) - 3, 1), len(l) + 1), lambda i: array_to_string(l[i:], ' ') || '::' || left(l[1], 1))) from w)"
_SHORT = "(with w as (select list_filter(string_split({0}, ' '), lambda x: x <> '') l) select case when len(l) < 2 then {0} || '::' else array_to_string(l[1:len(l) - 1], ' ') || '::' || left(l[len(l)], 1) end from w)"

ORACLES = {
    "m_linked_plain": f"""with {_LINK},
lc as (select f.row_id, q.*, f.na, abs(datediff('day', f.d, q.d)) gap, {_SAME_EVENT} sim from fn f join qn q on least(f.na, f.nb) = least(q.n1, q.n2) and greatest(f.na, f.nb) = greatest(q.n1, q.n2) and abs(datediff('day', f.d, q.d)) <= 8),
lb as (select *, n1 <> na sw from lc qualify row_number() over (partition by row_id order by gap, sim desc, odds_id) = 1),
lo as (select *, case when sw then odd2 else odd1 end a, case when sw then odd1 else odd2 end b from lb), lp as (select *, (1 / a) / (1 / a + 1 / b) pr from lo)
select row_id, odds_id, gap::int odds_date_gap, sim odds_event_similarity, round(a, 6) odd_a, round(b, 6) odd_b, round(pr, 6) market_probability_a, round(ln(least(greatest(pr, 1e-5), 1 - 1e-5) / (1 - least(greatest(pr, 1e-5), 1 - 1e-5))), 6) market_logit_a from lp""",
    "m_link_signatures_plain": f"""with {_LINK},
fs as materialized (select *, {_SUFFIXES.format("na")} sa, {_SUFFIXES.format("nb")} sb from fn), qs as materialized (select *, {_SHORT.format("n1")} s1, {_SHORT.format("n2")} s2 from qn),
fk as (select distinct row_id, least(x, y) k1, greatest(x, y) k2 from (select row_id, unnest(sa) x, sb from fs) t, unnest(sb) u(y)),
j as (select distinct f.row_id, q.odds_id from fk f join qs q on f.k1 = least(s1, s2) and f.k2 = greatest(s1, s2)),
lc as (select f.row_id, q.odds_id, abs(datediff('day', f.d, q.d)) gap, {_SAME_EVENT} sim from j join fs f using (row_id) join qs q using (odds_id)
 where abs(datediff('day', f.d, q.d)) <= 8 and ((list_contains(sa, s1) and list_contains(sb, s2)) or (list_contains(sa, s2) and list_contains(sb, s1)))),
lb as (select * from lc qualify row_number() over (partition by row_id order by gap, sim desc, odds_id) = 1)
select fn.row_id, case when b.odds_id is not null then 'matched' when fn.row_id in (select row_id from j) then 'date_or_orientation_fail' else 'no_pair' end status, b.odds_id, gap::int gap,
 case when b.odds_id is not null then count(*) over (partition by b.odds_id) end reuse from fn left join lb b using (row_id)""",
    "m_canonical": f"with {_CANON} select row_id, source_kind, tourney_id, surface, indoor_known, indoor_flag, tourney_level, level_role, tourney_date, proxy_date, round, round_order, match_num, best_of, winner_key, loser_key, winner_rank, loser_ht, w_svpt, is_retirement, is_walkover, is_clean, is_target from c",
    "m_names": f"select name, {_NORM.format('name')} normalized from (select winner_name name from tiny union select loser_name from tiny) where name is not null",
    "m_dedupe": f"with {_ONCE} select row_id, tourney_id, round, winner_key, loser_key from m",
    "m_source_counts": f"with {_CANON} select source_kind, level_role, count(*) n from c group by all",
    "m_score_shares": r"""
with t as (select row_id, upper(trim(coalesce(score, ''))) s from tiny),
k as (select row_id, s, unnest(string_split_regex(replace(replace(s, 'RET', ''), 'DEF', ''), '\s+')) tok from t),
g as (select row_id, regexp_extract(regexp_replace(tok, '\([^)]*\)', '', 'g'), '^(\d+)-(\d+)$', ['a', 'b']) x from k where not starts_with(tok, '[')),
n as (select row_id, x.a::int a, x.b::int b from g where x.a <> ''),
z as (select row_id, count(*) filter (a > b) w, count(*) filter (a < b) l, sum(a) ga, sum(b) gb from n group by row_id)
select t.row_id, case when not contains(s, 'W/O') and not contains(s, 'WALKOVER') then round(w::double / nullif(w + l, 0), 6) end set_share,
 case when not contains(s, 'W/O') and not contains(s, 'WALKOVER') then round(ga::double / nullif(ga + gb, 0), 6) end game_share from t left join z using (row_id)""",
    "m_match_rates": f"""with {_CANON},
x as (select row_id, (w_1stwon + w_2ndwon) / nullif(w_svpt, 0) ws, (l_1stwon + l_2ndwon) / nullif(l_svpt, 0) ls, (w_bpfaced - w_bpsaved) / nullif(w_svgms, 0) wb, (l_bpfaced - l_bpsaved) / nullif(l_svgms, 0) lb from c)
select row_id, round(ws, 6) w_spw, round(1 - ls, 6) w_rpw, round(1 - wb, 6) w_hold, round(lb, 6) w_break, round(ls, 6) l_spw, round(1 - ws, 6) l_rpw, round(1 - lb, 6) l_hold, round(wb, 6) l_break from x""",
    "m_past_counts": f"""with {_SIDES}, q as (select *, is_clean::int c, datediff('day', date '1970-01-01', d) n from p)
select row_id, side, player, coalesce(sum(c) over b, 0)::bigint experience, coalesce(sum(c) over s, 0)::bigint surface_experience,
 case when max(case when is_clean then n end) over b is null then 21 else least(n - max(case when is_clean then n end) over b, 60) end::double rest_days,
 least(coalesce(sum(c) over w7, 0), 140)::bigint workload_7d, least(coalesce(sum(c) over w14, 0), 140)::bigint workload_14d, least(coalesce(sum(c) over w28, 0), 140)::bigint workload_28d from q
window b as (partition by player order by n range between unbounded preceding and 1 preceding), s as (partition by player, surface order by n range between unbounded preceding and 1 preceding),
 w7 as (partition by player order by n range between 7 preceding and 1 preceding), w14 as (partition by player order by n range between 14 preceding and 1 preceding), w28 as (partition by player order by n range between 28 preceding and 1 preceding)""",
    "m_last_known": f"""with {_SIDES}, q as (select *, datediff('day', date '1970-01-01', d) n from p)
select row_id, side, player, coalesce(rank, (max(case when is_clean and rank is not null then (d, tourney_id, round_order, match_num, winner_key, loser_key, row_id, rank) end) over b)[8]) rank,
 coalesce(points, (max(case when is_clean and points is not null then (d, tourney_id, round_order, match_num, winner_key, loser_key, row_id, points) end) over b)[8]) points from q
window b as (partition by player order by n range between unbounded preceding and 1 preceding)""",
    "m_head_to_head": f"""with {_ONCE}
select a.row_id, count(*) filter (b.winner_key = a.winner_key) w_h2h, count(*) filter (b.winner_key = a.loser_key) l_h2h from m a left join m b
 on least(a.winner_key, a.loser_key) = least(b.winner_key, b.loser_key) and greatest(a.winner_key, a.loser_key) = greatest(b.winner_key, b.loser_key) and b.is_clean and b.proxy_date < a.proxy_date group by a.row_id""",
    "m_decayed": f"""with {_SIDES},
o as (select *, row_number() over (partition by player order by d, tourney_id, round_order, match_num, winner_key, loser_key, row_id) k from p where is_clean),
r as (select row_id, side, player, d, (select count(*) from o where o.player = p.player and o.d < p.d) k from p)
select r.row_id, r.side, r.player, {_decay("win_35", "o.won", "true", 35)}, {_decay("win_90", "o.won", "true", 90)}, {_decay("spw_90", "o.spw", "true", 90)}, {_decay("win_clay_180", "o.won", "o.surface = 'Clay'", 180)}
from r left join o on o.player = r.player and o.k <= r.k and o.k > r.k - 140 group by r.row_id, r.side, r.player""",
    "m_quotes": f"""select odds_id, date::date date, odd1, odd2, case when sf in ('Hard', 'Clay', 'Grass', 'Carpet') then sf else 'Unknown' end surface,
 {_NORM.format("coalesce(player1, '')")} player1_key_name, {_NORM.format("coalesce(player2, '')")} player2_key_name
 from (select *, upper(left(trim(surface), 1)) || lower(substr(trim(surface), 2)) sf from odds_template) where date is not null and odd1 > 1 and odd2 > 1""",
    "m_link_exact": f"""with {_ONCE}, f as (select row_id, tourney_date d, least({_NORM.format('winner_name')}, {_NORM.format('loser_name')}) a, greatest({_NORM.format('winner_name')}, {_NORM.format('loser_name')}) b from m),
q as (select date::date d, least({_NORM.format("coalesce(player1, '')")}, {_NORM.format("coalesce(player2, '')")}) a, greatest({_NORM.format("coalesce(player1, '')")}, {_NORM.format("coalesce(player2, '')")}) b from odds_template where date is not null and odd1 > 1 and odd2 > 1),
j as (select f.row_id, count(q.d) n, min(case when abs(datediff('day', f.d, q.d)) <= 8 then abs(datediff('day', f.d, q.d)) end) gap from f left join q using (a, b) group by f.row_id)
select row_id, case when gap is not null then 'matched' when n > 0 then 'date_gap' else 'no_pair' end status, gap::int gap from j""",
    "m_metrics": f"with {_PRED}, " + _metric("e", "surface").replace("{p}", "p"),
    "m_model_metrics": f"with {_PRED}, u as (select 'p' model, target, p v from e union all select 'p_points', target, p_points from e), " + _metric("u", "model").replace("{p}", "v"),
    "m_calibration": f"""with {_PRED}, b as (select list_sort(list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) l from e where p is not null),
x as (select target, p, len(list_filter(l[2:len(l) - 1], lambda v: p > v)) k, l from e, b where p is not null)
select round(l[k + 1], 6) low, round(l[k + 2], 6) high, count(*) n, round(avg(p), 6) mean_prediction, round(avg(target), 6) win_rate, round(avg(target) - avg(p), 6) error from x group by k, l""",
    "m_periods": f"""with {_EDGE}, b as (select surface, strftime(tourney_date, '%Y-%m') m, count(*) n, sum(gain) s, max(gain) t, count(*) filter (gain > 0) h from g group by all)
select surface, sum(n)::bigint n, round(sum(s), 6) total, round(sum(s) / sum(n), 6) mean, round(sum(h) / sum(n), 6) hit_rate, round(sum(s) - greatest(max(t), 0), 6) total_without_best, count(*) periods,
 round(median(s / n), 6) median_period, round(min(s / n), 6) worst_period, round(avg((s / n > 0)::int), 6) good_periods from b group by surface""",
    "m_bands": f"""with {_EDGE}, b as (select target, case when p >= 0 and p < 0.2 then '[0, 0.2)' when p >= 0.2 and p < 0.4 then '[0.2, 0.4)' when p >= 0.4 and p < 0.6 then '[0.4, 0.6)' when p >= 0.6 and p < 0.8 then '[0.6, 0.8)' when p >= 0.8 and p < 1 then '[0.8, 1)' end band from g)
select band, count(*) n, round(avg(target), 6) win_rate from b where band is not null group by band""",
    "m_largest_fall": f"""with {_EDGE}, s as (select surface, tourney_date, row_id, sum(gain) over (partition by surface order by tourney_date, row_id rows unbounded preceding) s from g)
select surface, round(max(greatest(pk, 0) - s), 6) largest_fall from (select *, max(s) over (partition by surface order by tourney_date, row_id rows unbounded preceding) pk from s) group by surface""",
    "m_top_fraction": f"""with {_EDGE}, x as (select row_id, tourney_date, p, greatest(1, ceil(0.1::double * count(*) over (partition by tourney_date)))::int cap, row_number() over (partition by tourney_date order by p desc, row_id)::int place from g)
select row_id, tourney_date, p, place, cap from x where place <= cap""",
    "m_grid": f"""with {_EDGE}, k as (select * from (values ('0.05/0.5', 0.05::double, 0.5::double), ('0.05/0.7', 0.05, 0.7), ('0.1/0.5', 0.1, 0.5), ('0.1/0.7', 0.1, 0.7), ('0.25/0.5', 0.25, 0.5), ('0.25/0.7', 0.25, 0.7)) t(policy, fraction, floor)),
z as (select *, count(*) over (partition by tourney_date) sz from g), x as (select policy, gain, greatest(1, ceil(fraction * sz)) cap, row_number() over (partition by policy, tourney_date order by p desc, row_id) pl from z join k on p >= floor)
select policy, count(*) n, round(avg(gain), 6) mean_gain from x where pl <= cap group by policy""",
    "m_event_weeks": f"with {_CANON} select tourney_date, coalesce(tourney_id, '') tourney_id, count(*) \"rows\", bool_or(upper(trim(round)) = 'F') has_final from c where tourney_level = 'C' group by 1, 2",
    "m_targets": f"with {_CANON} select round, count(*) filter (is_target) before, count(*) filter (is_target and trim(round) not in ('Q1', 'Q2', 'Q3', 'Q4')) after from c group by round",
    "m_rounds": f"with {_CANON} select tourney_id, tourney_date, array_to_string(list_sort(list(distinct upper(trim(round)))), ',') rounds from c group by 1, 2",
    "m_ratings": feature_sql.ratings(_ONCE),
    "m_ratings_by_row": feature_sql.ratings(_ONCE, by_day=False),
    "m_features": feature_sql.features(_ONCE),
    "m_mirrored": feature_sql.mirrored(_ONCE),
    "m_live": feature_sql.live(_ONCE, _NORM),
    "m_grid_summary": f"""with {_EDGE}, k as (select * from (values ('0.05/0.5', 0.05::double, 0.5::double), ('0.05/0.7', 0.05, 0.7), ('0.1/0.5', 0.1, 0.5), ('0.1/0.7', 0.1, 0.7), ('0.25/0.5', 0.25, 0.5), ('0.25/0.7', 0.25, 0.7)) t(policy, fraction, floor)),
z as (select *, count(*) over (partition by tourney_date) sz from g), x as (select policy, gain, strftime(tourney_date, '%Y-%m') mo, greatest(1, ceil(fraction * sz)) cap, row_number() over (partition by policy, tourney_date order by p desc, row_id) pl from z join k on p >= floor),
b as (select policy, mo, count(*) n, sum(gain) s, max(gain) t, count(*) filter (gain > 0) h from x where pl <= cap group by all)
select policy, sum(n)::bigint n, round(sum(s), 6) total, round(sum(s) / sum(n), 6) mean, round(sum(h) / sum(n), 6) hit_rate, round(sum(s) - greatest(max(t), 0), 6) total_without_best, count(*) periods,
 round(median(s / n), 6) median_period, round(min(s / n), 6) worst_period, round(avg((s / n > 0)::int), 6) good_periods from b group by policy""",
    "m_selection": f"""with {_EDGE}, z as (select *, greatest(1, ceil(0.1::double * count(*) over (partition by tourney_date)))::int cap from g), x as (select *, row_number() over (partition by tourney_date order by p desc, row_id)::int place from z where p >= 0.6 and gain <= 0.3)
select row_id, tourney_date, place, cap from x where place <= cap""",
    "m_sample": "select row_id, tourney_id from (select row_id, tourney_id, row_number() over (order by row_id) - 1 n from tiny) where n % 10 = 0",
}
ORACLES["m_link_quality"] = f"""with x as ({ORACLES["m_link_exact"]}) select status, count(*) n, round(median(gap), 6) gap_median, round(quantile_cont(gap, 0.05), 6) gap_p05, round(count(*) / (select count(*) from x), 6) share from x group by status"""
ORACLES["m_chosen"] = f"""with x as ({ORACLES["m_grid"]}) select policy, n, mean_gain from x order by (n >= 100) desc, case when n >= 100 then mean_gain else n end desc, policy limit 1"""
