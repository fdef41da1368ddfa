"""Leakage-safe feature rows: both players' snapshots before a match, as differences and shared values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rallyframe.functions.names import normalize_name
from rallyframe.functions.scalars import ROLES, SURFACES, clean_surface, entry_flags, finite
from rallyframe.operators.history import RATES, decayed_means, decays_of_features, head_to_head, head_to_head_advantage, last_known, past_counts, player_rows
from rallyframe.operators.ratings import FAMILIES, RatingConfig, pre_match_ratings

#: Rates whose decayed weights tell how well a player's statistics are covered.
COVERED = ("spw", "rpw", "hold", "break")
#: Matches on a surface at which its own rating weighs half.
SURFACE_PRIOR = 8.0
#: Values of a player without history.
DEFAULTS = {"rank": 750.0, "points": 5.0, "age": 25.0, "height": 183.0}
MEANS = {"recent_residual_35": 0.0, "recent_residual_90": 0.0, "recent_residual_180": 0.0, "surface_residual_180": 0.0, "recent_win_35": 0.5, "recent_win_90": 0.5} | {f"{r}_90": 0.5 for r in RATES} | {f"{r}_residual_180": 0.0 for r in ROLES}

# Names and divisors of the features.
#: Feature -> (value of a snapshot, divisor): A's minus B's.
_PLAIN = {
    "elo_slow_diff_100": ("slow", 100.0), "elo_dynamic_diff_100": ("dynamic", 100.0), "elo_fast_diff_100": ("fast", 100.0), "elo_surface_diff_100": ("surface_rating", 100.0),
    "elo_surface_blend_diff_100": ("surface_blend", 100.0), "elo_dynamic_surface_blend_diff_100": ("dynamic_blend", 100.0), "elo_speed_gap_diff_100": ("speed_gap", 100.0),
    "points_log_diff": ("points_log", 1.0), "age_diff_10": ("age", 10.0), "height_diff_10": ("height", 10.0), "experience_log_diff": ("experience_log", 1.0),
    "surface_experience_log_diff": ("surface_experience_log", 1.0), "opp_elo_90_diff_100": ("opp_elo_90", 100.0), "rest_days_diff_14": ("rest_days", 14.0),
}
_PLAIN |= {f"{m}_diff": (m, 1.0) for m in MEANS} | {f"workload_{n}d_diff": (f"workload_{n}d", 1.0) for n in (7, 14, 28)} | {f"entry_{e}_diff": (f"entry_{e}", 1.0) for e in ("q", "wc", "ll", "pr")}
DIFF_FEATURES = [*_PLAIN, "rank_log_diff", "h2h_advantage"]
SHARED_FEATURES = ["min_experience", "min_surface_experience", "min_stat_matches", "stat_coverage", "h2h_matches", *[f"surface_{s.lower()}" for s in SURFACES], "indoor_flag", "indoor_known", "round_order_scaled", "best_of_5"]
FEATURES = DIFF_FEATURES + SHARED_FEATURES


def _means(need: set[str]) -> dict:
    """The decayed means behind the values ``need`` of a snapshot."""
    every = decays_of_features()
    names = {n for n in every if n in need}
    names |= {f"{s}_residual_180" for s in SURFACES} if "surface_residual_180" in need else set()
    names |= {f"{r}_90" for r in COVERED} if "stat_matches" in need else set()
    return {n: x for n, x in every.items() if n in names}


def _snapshots(matches: DataFrame, config: RatingConfig, need: set[str], wanted: Column) -> DataFrame:
    """One row per side of each ``wanted`` match, with what is ``need``ed of all that is known of the player before the day."""
    ratings = pre_match_ratings(matches, config=config, place="place__")
    more = {"place__": ("place__", "place__"), "wanted__": ("wanted__", "wanted__"), "residual": (1.0 - F.col("expected"), 0.0 - (1.0 - F.col("expected"))), "opponent_rating": ("l_slow", "w_slow")}
    more |= {"surface_rating" if f == "surface" else f: (f"w_{f}", f"l_{f}") for f in FAMILIES}
    means, last = _means(need), [c for c in DEFAULTS if c in need or c == "points" and "points_log" in need]
    only = {"row_id", "side", "player", "day", "surface", "is_clean", "place__", "wanted__", *last, *[r for r in RATES if f"{r}_90" in means]}
    only |= {c for c, prefix in (("won", "recent_win"), ("opponent_rating", "opp_elo"), ("residual", ""), ("level_role", "")) if any(prefix in m if prefix else "residual" in m for m in means)}
    only |= {c for c in ("slow", "dynamic", "fast", "surface_rating", "surface_dynamic") if {c, *{"slow": ("surface_blend", "speed_gap"), "dynamic": ("dynamic_blend",), "fast": ("speed_gap",), "surface_rating": ("surface_blend",), "surface_dynamic": ("dynamic_blend",)}[c]} & need}
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rated = player_rows(matches.withColumn("wanted__", F.coalesce(wanted, F.lit(False))).join(ratings, "row_id"), more={n: tuple(column(c) for c in x) for n, x in more.items()}, only=only)
    known = decayed_means(rated, means, by=["place__"]) if means else rated
    known = last_known(past_counts(known), tuple(last), ["place__"]).where("wanted__")
    share = F.col("surface_experience") / (F.col("surface_experience") + F.lit(SURFACE_PRIOR))
    blend = lambda a, b: share * F.col(a) + (1.0 - share) * F.col(b)
    own = F.coalesce(*[F.when(F.col("surface") == s, F.col(f"{s}_residual_180")) for s in SURFACES])
    ranked = {"rank": F.when(F.col("rank") > 0, F.col("rank")).otherwise(F.lit(DEFAULTS["rank"])), "points": F.when(F.col("points") >= 0, F.col("points")).otherwise(F.lit(DEFAULTS["points"]))}
    values = {c: F.col(c) for c in need if c in known.columns} | {m: F.coalesce(own if m == "surface_residual_180" else F.col(m), F.lit(d)) for m, d in MEANS.items()} | {"opp_elo_90": F.coalesce("opp_elo_90", F.lit(config.base))}
    values |= ranked | {c: F.coalesce(c, F.lit(DEFAULTS[c])) for c in ("age", "height")}
    values |= {
        "surface_blend": blend("surface_rating", "slow"), "dynamic_blend": blend("surface_dynamic", "dynamic"), "speed_gap": F.col("fast") - F.col("slow"),
        "experience_log": F.log1p(F.col("experience").cast("double")), "surface_experience_log": F.log1p(F.col("surface_experience").cast("double")),
        "stat_matches": F.least(*[F.col(f"{r}_90_n") for r in COVERED]), "points_log": F.log1p(F.greatest(ranked["points"], F.lit(0.0))),
    }
    return known.select("row_id", "side", *[values[c].alias(c) for c in sorted(need)])


def build_features(matches: DataFrame, config: RatingConfig | None = None, rows: Column | None = None, meta: tuple[str, ...] = (), only: list[str] | None = None) -> DataFrame:
    """A row per target match: ids, sides A and B, the result, and FEATURES, all known before its day.

    A is the player whose key sorts first, whoever won; ``target`` is 1 if A won. All matches of a
    day see the state from before the day. ``matches`` is canonical with a unique ``row_id``;
    ``rows`` says which matches get a row (targets by default). An empty table gives no rows. With
    ``only`` there are these columns alone; what no one of them needs is neither carried nor worked out.
    """
    config = config or RatingConfig()
    asked = lambda c: only is None or c in only
    wanted = rows if rows is not None else F.col("is_target")
    stats = [c for c in ("min_stat_matches", "stat_coverage") if asked(c)]
    need = {c for n, (c, _) in _PLAIN.items() if asked(n) and not c.startswith("entry_")} | {x for n, x in (("rank_log_diff", "rank"), ("min_experience", "experience"), ("min_surface_experience", "surface_experience")) if asked(n)} | ({"stat_matches"} if stats else set())
    snaps = _snapshots(matches, config, need, wanted)
    packed = snaps.groupBy("row_id").agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}__{c}") for s in ("w", "l") for c in sorted(need)])
    first = F.col("winner_key") < F.col("loser_key")
    ab = lambda x, y: (F.when(first, x).otherwise(y), F.when(first, y).otherwise(x))
    joined = matches.where(wanted).join(packed, "row_id")
    if asked("h2h_advantage") or asked("h2h_matches"):
        joined = joined.join(head_to_head(matches), "row_id")

    def sides(c: str) -> tuple[Column, Column]:
        """A value of A and of B."""
        if c.startswith("entry_"):
            return ab(entry_flags("winner_entry")[c[6:]], entry_flags("loser_entry")[c[6:]])
        return tuple(x.cast("double") for x in ab(F.col(f"w__{c}"), F.col(f"l__{c}")))

    def difference(c: str, d: float) -> Column:
        a, b = sides(c)
        return (a - b) / F.lit(d)

    out = {n: difference(c, d) for n, (c, d) in _PLAIN.items()}
    (rank_a, rank_b), (mine, other), stat = sides("rank"), ab(F.col("w_h2h"), F.col("l_h2h")), F.least(*sides("stat_matches"))
    out |= {
        "rank_log_diff": F.ln(F.greatest(rank_b, F.lit(1.0))) - F.ln(F.greatest(rank_a, F.lit(1.0))),
        "h2h_advantage": head_to_head_advantage(mine, other), "h2h_matches": (mine + other).cast("double"),
        "min_experience": F.least(*sides("experience")), "min_surface_experience": F.least(*sides("surface_experience")),
        "min_stat_matches": stat, "stat_coverage": stat / (stat + 5.0), "round_order_scaled": F.col("round_order") / F.lit(10.0), "best_of_5": (F.col("best_of") == 5).cast("double"),
        "indoor_flag": F.col("indoor_flag"), "indoor_known": F.col("indoor_known"),
    } | {f"surface_{s.lower()}": (F.col("surface") == s).cast("double") for s in SURFACES}
    names, keys = ab(F.col("winner_name"), F.col("loser_name")), ab(F.col("winner_key"), F.col("loser_key"))
    about = {"row_id": F.col("row_id"), "date": F.col("proxy_date"), "event_start_date": F.col("tourney_date")} | {c: F.col(c) for c in ("tourney_id", "tourney_name", "surface", "round")}
    about |= {"player_a": names[0], "player_b": names[1], "player_a_key": keys[0], "player_b_key": keys[1], "target": first.cast("int")}
    about |= {c: F.col(c) for c in ("winner_name", "loser_name", "winner_rank", "loser_rank", *meta)}
    return joined.select(*[c.alias(n) for n, c in (about | {n: out[n] for n in FEATURES}).items() if asked(n)])


def resolve_players(slate: DataFrame, matches: DataFrame, name: str, player_id: str | None, to: str) -> DataFrame:
    """``slate`` with the key ``to`` of a named player: the id if it was ever seen, else the key last seen
    under the normalized name, else ``name:`` and that name."""
    sides = [matches.select(F.col(f"{s}_key").alias("key"), F.col(f"{s}_name").alias("n"), F.struct("proxy_date", "round_order", "match_num", "row_id", F.lit(i)).alias("at")) for i, s in enumerate(("winner", "loser"))]
    seen = sides[0].unionByName(sides[1])
    by_spelling = seen.groupBy("n", "key").agg(F.max("at").alias("at")).withColumn("norm__", normalize_name("n"))
    by_name = by_spelling.groupBy("norm__").agg(F.max_by("key", F.struct("at", "key")).alias("named__"))
    keys = seen.select(F.col("key").alias("known__")).distinct()
    df = slate.withColumn("norm__", normalize_name(name)).withColumn("known__", F.col(player_id) if player_id else F.lit(None).cast("string"))
    df = df.join(keys.withColumn("hit__", F.lit(True)), "known__", "left").join(by_name, "norm__", "left")
    return df.withColumn(to, F.coalesce(F.when(F.col("hit__"), F.col("known__")), "named__", F.concat(F.lit("name:"), "norm__"))).drop("norm__", "known__", "hit__", "named__")


def live_features(matches: DataFrame, slate: DataFrame, config: RatingConfig | None = None) -> DataFrame:
    """FEATURES of unplayed fixtures, as of the state before each fixture's day; nothing is updated.

    ``slate`` has ``slate_id``, date, player1, player2, surface, round, round_order, best_of,
    tournament, and rank, points, age, height and entry of both; missing numbers take their
    defaults. Output as ``build_features`` with ``slate_id``, without results. Fixtures without a
    date or a name, or of a player against themselves, are left out.
    """
    for side, col in (("1", "k1"), ("2", "k2")):
        slate = resolve_players(slate, matches, f"player{side}", f"player{side}_id" if f"player{side}_id" in slate.columns else None, col)
    text, num = F.lit(None).cast("string"), F.lit(None).cast("double")
    opt = lambda c, none: F.col(c) if c in slate.columns else none
    fixed = slate.where("date is not null and player1 is not null and player2 is not null and k1 <> k2")
    rows = fixed.select(
        (-1 - F.col("slate_id").cast("long")).alias("row_id"), F.col("slate_id"), F.col("date").cast("date").alias("tourney_date"), F.col("date").cast("date").alias("proxy_date"), opt("tourney_id", F.lit("LIVE")).alias("tourney_id"),
        opt("tournament", text).alias("tourney_name"), clean_surface("surface").alias("surface"), opt("round", text).alias("round"), finite("round_order", 6.0).cast("int").alias("round_order"), finite("best_of", 3.0).alias("best_of"),
        finite(opt("indoor_flag", num), 0.0).alias("indoor_flag"), finite(opt("indoor_known", num), 0.0).alias("indoor_known"), F.lit(0.0).alias("match_num"), F.lit("").alias("score"), F.lit("challenger").alias("level_role"),
        F.lit(False).alias("is_clean"), F.lit(False).alias("is_target"),
        *[c for s, side in (("1", "winner"), ("2", "loser")) for c in (F.col(f"k{s}").alias(f"{side}_key"), F.col(f"player{s}").alias(f"{side}_name"), finite(f"rank{s}").alias(f"{side}_rank"), finite(f"points{s}").alias(f"{side}_rank_points"), finite(f"age{s}").alias(f"{side}_age"), finite(f"height{s}").alias(f"{side}_ht"), F.upper(F.coalesce(f"entry{s}", F.lit(""))).alias(f"{side}_entry"))],
    )
    both = matches.unionByName(rows, allowMissingColumns=True)
    out = build_features(both, config, F.col("slate_id").isNotNull(), ("slate_id",))
    return out.drop("target", "winner_name", "loser_name", "winner_rank", "loser_rank", "row_id")


def mirror(df: DataFrame) -> DataFrame:
    """The same matches seen from B: differences negated, shared features as they are."""
    return df.withColumns({c: -F.col(c) for c in DIFF_FEATURES if c in df.columns})


def augment_symmetric(df: DataFrame, target: str = "target") -> DataFrame:
    """Every row, and its mirror with the opposite target."""
    return df.unionByName(mirror(df).withColumn(target, (1 - F.col(target)).cast(df.schema[target].dataType)))


def reliability(dispersion: str | Column) -> Column:
    """From 0 to 1: how much history a feature row stands on and how far its models agree."""
    d = F.col(dispersion) if isinstance(dispersion, str) else dispersion
    agree = F.least(F.greatest(1.0 - d / 0.18, F.lit(0.0)), F.lit(1.0))
    x = 0.32 * F.least(F.col("min_experience"), F.lit(24.0)) / 24.0 + 0.23 * F.least(F.col("min_surface_experience"), F.lit(12.0)) / 12.0 + 0.15 * F.coalesce("stat_coverage", F.lit(0.0)) + 0.30 * agree
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
