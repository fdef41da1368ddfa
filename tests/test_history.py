"""Ratings, history windows and features against plain loops over a small random season."""

import math
import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import features as feat
from rallyframe.operators.history import decayed_means, head_to_head, past_counts, player_rows
from rallyframe.operators.matches import canonical_matches
from rallyframe.operators.ratings import pre_match_ratings

RAW = "row_id long, tourney_id string, tourney_name string, tourney_level string, tourney_date string, winner_name string, loser_name string, surface string, round string, winner_id string, loser_id string, score string, winner_rank double, loser_rank double, w_svpt double, w_1stwon double, w_2ndwon double, winner_ht double"


@pytest.fixture(scope="module")
def season(spark):
    rng = random.Random(3)
    rows = []
    for i in range(160):
        w, l = rng.sample("ABCDE", 2)
        day = date(2023, 1, 2) + timedelta(days=7 * rng.randrange(20))
        score = rng.choice(["6-4 6-3"] * 8 + ["6-4 2-1 RET", "W/O"])
        sv = None if rng.random() < 0.2 else 60.0
        rows.append((i, f"t{rng.randrange(3)}", "T", rng.choice("CA"), day.strftime("%Y%m%d"), w, l, rng.choice(["Hard", "Clay"]), rng.choice(["R32", "R16", "Q1", "F"]), w, l, score, rng.choice([None, 10.0, 100.0]), rng.choice([None, 55.0]), sv, 30.0, 5.0 + i % 7, None if i % 5 else 180.0 + i % 9))
    df = canonical_matches(spark.createDataFrame(rows, RAW), keep=("row_id",)).cache()
    order = lambda r: (r.proxy_date, r.tourney_id, r.round_order, r.match_num, r.winner_key, r.loser_key, r.row_id)
    return df, sorted(df.collect(), key=order)


def seed(rank):
    return 1500.0 if not rank else 1500 + 0.45 * (min(max(2000 - 250 * math.log10(rank), 1150), 2050) - 1500)


def expect(d):
    return 1 / (1 + 10 ** (-d / 400))


def replay(rows, by_day=True):
    """Slow and surface ratings of both sides before each match, and the winner's expected score."""
    slow, surf, out, wait, day = {}, {}, {}, [], None

    def apply(r):
        w, l, s = r.winner_key, r.loser_key, r.surface
        a, b = surf.get((w, s), slow[w]), surf.get((l, s), slow[l])
        d, e = 22 * (1 - expect(slow[w] - slow[l])), 34 * (1 - expect(a - b))
        slow[w] += d
        slow[l] -= d
        surf[w, s], surf[l, s] = a + e, b - e

    for r in rows:
        if by_day and r.proxy_date != day:
            for x in wait:
                apply(x)
            wait, day = [], r.proxy_date
        slow.setdefault(r.winner_key, seed(r.winner_rank))
        slow.setdefault(r.loser_key, seed(r.loser_rank))
        s = r.surface
        out[r.row_id] = (slow[r.winner_key], slow[r.loser_key], surf.get((r.winner_key, s), slow[r.winner_key]), expect(slow[r.winner_key] - slow[r.loser_key]))
        if r.is_clean:
            wait.append(r) if by_day else apply(r)
    return out


def test_ratings_by_day_equal_a_plain_loop(season):
    df, rows = season
    want = replay(rows)
    got = {r.row_id: (r.w_slow, r.l_slow, r.w_surface, r.expected) for r in pre_match_ratings(df).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_ratings_by_row_equal_a_plain_loop(season):
    df, rows = season
    rows = sorted(rows, key=lambda r: (r.tourney_date, r.round_order, r.match_num, r.winner_key, r.loser_key, r.row_id))
    want = replay(rows, by_day=False)
    got = {r.row_id: (r.w_slow, r.l_slow, r.w_surface, r.expected) for r in pre_match_ratings(df, replay="row").collect()}
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def test_universes_are_folded_apart_and_keep_their_sum(season, spark):
    df, _ = season
    two = df.withColumn("u", (F.col("row_id") % 2).cast("string"))
    got = pre_match_ratings(two, universe="u").orderBy("row_id").collect()
    for u in (0, 1):
        alone = pre_match_ratings(df.where(F.col("row_id") % 2 == u)).orderBy("row_id").collect()
        assert [tuple(r) for r in got if r.row_id % 2 == u] == [tuple(r) for r in alone]
    assert pre_match_ratings(df.limit(0)).count() == 0


def observations(rows):
    out = defaultdict(list)
    for r in rows:
        if r.is_clean:
            out[r.winner_key].append((r.proxy_date, 1.0, r.surface, (r.w_1stwon + r.w_2ndwon) / r.w_svpt if r.w_svpt else None))
            out[r.loser_key].append((r.proxy_date, 0.0, r.surface, None))
    return out


@pytest.mark.parametrize("cap", [140, 7])
def test_decayed_means_cap_before_they_filter(season, cap):
    df, rows = season
    obs = observations(rows)
    decays = {"a": (F.col("won"), F.lit(True), 35), "b": (F.col("spw"), F.lit(True), 90), "c": (F.col("won"), F.col("surface") == "Clay", 180)}
    for r in decayed_means(player_rows(df), decays, cap).collect():
        today = date(1970, 1, 1) + timedelta(days=r.day)
        past = [o for o in obs[r.player] if o[0] < today][-cap:]
        for name, half, pick in (("a", 35, lambda o: o[1]), ("b", 90, lambda o: o[3]), ("c", 180, lambda o: o[1] if o[2] == "Clay" else None)):
            xs = [(pick(o), 2 ** (-(today - o[0]).days / half)) for o in past if pick(o) is not None]
            n = sum(w for _, w in xs)
            assert r[f"{name}_n"] == pytest.approx(n, abs=1e-9)
            assert (r[name] is None) == (not xs) and (not xs or r[name] == pytest.approx(sum(v * w for v, w in xs) / n, abs=1e-9))


def test_counts_and_head_to_head(season):
    df, rows = season
    obs = observations(rows)
    for r in past_counts(player_rows(df)).collect():
        today = date(1970, 1, 1) + timedelta(days=r.day)
        past = [o for o in obs[r.player] if o[0] < today]
        assert r.experience == len(past) and r.surface_experience == sum(o[2] == r.surface for o in past)
        assert r.workload_14d == sum((today - o[0]).days <= 14 for o in past)
        assert r.rest_days == (min((today - max(o[0] for o in past)).days, 60) if past else 21)
    by_id = {r.row_id: r for r in rows}
    for r in head_to_head(df).collect():
        m = by_id[r.row_id]
        met = [x for x in rows if x.is_clean and x.proxy_date < m.proxy_date and {x.winner_key, x.loser_key} == {m.winner_key, m.loser_key}]
        assert (r.w_h2h, r.l_h2h) == (sum(x.winner_key == m.winner_key for x in met), sum(x.winner_key == m.loser_key for x in met))


def test_features_do_not_leak_and_mirror(season, spark):
    df, rows = season
    feats = feat.build_features(df).cache()
    assert feats.count() == sum(r.is_target for r in rows) and set(feat.FEATURES) <= set(feats.columns) and len(feat.FEATURES) == 53
    cut = sorted({r.proxy_date for r in rows})[12]
    # Other results from the cut on: earlier rows and those of the cut itself stay as they are.
    changed = df.where(F.col("proxy_date") < F.lit(cut)).unionByName(df.where(F.col("proxy_date") >= F.lit(cut)).withColumns({"is_clean": F.lit(False), "winner_rank": F.lit(1.0)}))
    again = {r.row_id: r for r in feat.build_features(changed).where(F.col("date") < F.lit(cut)).collect()}
    before = {r.row_id: r for r in feats.where(F.col("date") < F.lit(cut)).collect()}
    assert before == again and before
    both = feat.augment_symmetric(feats)
    sums = both.groupBy("row_id").agg(F.sum("target").alias("t"), *[F.sum(c).alias(c) for c in feat.DIFF_FEATURES]).collect()
    assert all(r.t == 1 and all(abs(r[c]) < 1e-9 for c in feat.DIFF_FEATURES) for r in sums)
    assert feat.build_features(df.limit(0)).count() == 0


def test_live_features_equal_those_of_a_match_on_the_same_day(season, spark):
    df, rows = season
    m = next(r for r in reversed(rows) if r.is_target)
    slate = spark.createDataFrame([(5, m.proxy_date, m.winner_name, m.loser_name, m.surface, m.winner_rank, m.loser_rank), (6, m.proxy_date, "Nobody", m.loser_name, None, None, None), (7, None, "a", "b", None, None, None)], "slate_id long, date date, player1 string, player2 string, surface string, rank1 double, rank2 double")
    slate = slate.withColumns({c: F.lit(None).cast("double") for c in ("points1", "points2", "age1", "age2", "height1", "height2", "best_of")} | {c: F.lit(None).cast("string") for c in ("entry1", "entry2", "round")} | {"round_order": F.lit(float(m.round_order))})
    got = {r.slate_id: r for r in feat.live_features(df, slate).collect()}
    assert set(got) == {5, 6} and "name:nobody" in (got[6].player_a_key, got[6].player_b_key)
    want = feat.build_features(df).where(F.col("row_id") == m.row_id).first()
    for c in feat.FEATURES:
        assert got[5][c] == pytest.approx(want[c], abs=1e-9), c


def test_some_features_equal_those_of_all_and_fold_once(season):
    df, _ = season
    only = ["row_id", "date", "target", "elo_slow_diff_100", "elo_dynamic_surface_blend_diff_100", "rank_log_diff", "recent_win_90_diff", "surface_residual_180_diff", "points_log_diff", "h2h_advantage", "min_experience", "stat_coverage"]
    some, every = feat.build_features(df, only=only), feat.build_features(df)
    assert some.columns == [c for c in every.columns if c in only]
    assert some.orderBy("row_id").collect() == every.select(*some.columns).orderBy("row_id").collect()
    assert some._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_a_busy_day_is_played_in_order(season):
    df, _ = season
    day = df.withColumns({"proxy_date": F.date_trunc("month", "proxy_date").cast("date")})
    order = lambda r: (r.proxy_date, r.tourney_id, r.round_order, r.match_num, r.winner_key, r.loser_key, r.row_id)
    want = replay(sorted(day.collect(), key=order))
    got = {r.row_id: (r.w_slow, r.l_slow, r.w_surface, r.expected) for r in pre_match_ratings(day).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
