"""A player's past at a day: decayed means, counts, last known values and head-to-head, as windows.

All of it excludes the day itself: a row of day D reads matches of days before D only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.scalars import ROLES, SURFACES, match_rates

#: Clean matches that decayed means and counts reach back, before any filter.
CAP = 140
RATES = ("spw", "rpw", "hold", "break", "set_share", "game_share")


def player_rows(matches: DataFrame, row_id: str = "row_id", more: dict[str, tuple[Column, Column]] | None = None, only: set[str] | None = None) -> DataFrame:
    """Two rows per match, winner and loser: ``row_id``, ``player``, ``opponent``, ``day`` (number), result, values and rates.

    ``more`` has further columns with their values for the winner and the loser. With ``only`` there
    are these columns alone, and both rows come from one pass over ``matches``.
    """
    rated = matches.withColumns({n: c for n, c in match_rates().items() if only is None or n[2:] in only})
    sides = []
    for i, (me, you, p, won) in enumerate((("winner", "loser", "w", 1.0), ("loser", "winner", "l", 0.0))):
        own = {"row_id": F.col(row_id), "side": F.lit(p), "player": F.col(f"{me}_key"), "opponent": F.col(f"{you}_key"), "day": F.unix_date("proxy_date")}
        own |= {c: F.col(c) for c in ("tourney_id", "round_order", "match_num", "winner_key", "loser_key", "surface", "level_role", "is_clean")} | {"won": F.lit(won)}
        own |= {a: F.col(f"{me}_{c}") for c, a in (("rank", "rank"), ("rank_points", "points"), ("age", "age"), ("ht", "height"))} | {r: F.col(f"{p}_{r}") for r in RATES}
        sides.append([c.alias(n) for n, c in (own | {n: x[i] for n, x in (more or {}).items()}).items() if only is None or n in only])
    if only is not None:
        return rated.select(F.explode(F.array(*[F.struct(*x) for x in sides])).alias("x")).select("x.*")
    sides = [rated.select(*x) for x in sides]
    return sides[0].unionByName(sides[1])


ORDER = ["day", "tourney_id", "round_order", "match_num", "winner_key", "loser_key", "row_id"]


def past_counts(rows: DataFrame) -> DataFrame:
    """``rows`` with the player's clean matches before the day: all, on the surface, in the last 7, 14 and 28 days, and days of rest.

    Counts over days are of the last CAP clean matches, like the means. Rest is 21 days for a first
    match and at most 60.
    """
    clean = F.col("is_clean").cast("long")
    by_day = Window.partitionBy("player").orderBy("day")
    before = by_day.rangeBetween(Window.unboundedPreceding, -1)
    on_surface = Window.partitionBy("player", "surface").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    count = lambda w: F.coalesce(F.sum(clean).over(w), F.lit(0))
    last = F.max(F.when(F.col("is_clean"), F.col("day"))).over(before)
    return rows.withColumns(
        {"experience": count(before), "surface_experience": count(on_surface), "rest_days": F.when(last.isNull(), F.lit(21)).otherwise(F.least(F.col("day") - last, F.lit(60))).cast("double")}
        | {f"workload_{n}d": F.least(count(by_day.rangeBetween(-n, -1)), F.lit(CAP)) for n in (7, 14, 28)}
    )


def last_known(rows: DataFrame, columns: tuple[str, ...] = ("rank", "points", "age", "height"), order: list[str] = ORDER) -> DataFrame:
    """``rows`` with null ``columns`` filled from the player's last clean match before the day that had them.

    Of several matches on one day the last in match order (``order``) counts.
    """
    before = Window.partitionBy("player").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    out = {}
    for c in columns:
        latest = F.max(F.when(F.col("is_clean") & F.col(c).isNotNull(), F.struct(*order, c))).over(before)
        out[c] = F.coalesce(F.col(c), latest.getField(c))
    return rows.withColumns(out)


def head_to_head(matches: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Per match, of the two players' clean meetings before its day: wins of the winner ``w_h2h`` and of the loser ``l_h2h``."""
    low, high = F.least("winner_key", "loser_key"), F.greatest("winner_key", "loser_key")
    rows = matches.select(F.col(row_id), low.alias("lo"), high.alias("hi"), F.unix_date("proxy_date").alias("day"), F.col("winner_key").alias("w"), "is_clean")
    before = Window.partitionBy("lo", "hi").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    won = lambda c: F.coalesce(F.sum((F.col("is_clean") & (F.col("w") == F.col(c))).cast("long")).over(before), F.lit(0))
    counted = rows.withColumns({"a": won("lo"), "b": won("hi")})
    mine = F.col("w") == F.col("lo")
    return counted.select(row_id, F.when(mine, F.col("a")).otherwise(F.col("b")).alias("w_h2h"), F.when(mine, F.col("b")).otherwise(F.col("a")).alias("l_h2h"))


def head_to_head_advantage(mine: str | Column, other: str | Column) -> Column:
    """The shrunk share of wins above a half."""
    a, b = [F.col(c) if isinstance(c, str) else c for c in (mine, other)]
    return (a + F.lit(1.5)) / (a + b + F.lit(3.0)) - F.lit(0.5)


def decays_of_features() -> dict[str, tuple[Column, Column, int]]:
    """Name -> (value, whether it counts, half-life in days) of each decayed mean."""
    yes = F.lit(True)
    out = {f"recent_residual_{h}": (F.col("residual"), yes, h) for h in (35, 90, 180)}
    out |= {f"recent_win_{h}": (F.col("won"), yes, h) for h in (35, 90)}
    out["opp_elo_90"] = (F.col("opponent_rating"), yes, 90)
    out |= {f"{r}_90": (F.col(r), yes, 90) for r in RATES}
    out |= {f"{r}_residual_180": (F.col("residual"), F.col("level_role") == r, 180) for r in ROLES}
    out |= {f"{s}_residual_180": (F.col("residual"), F.col("surface") == s, 180) for s in SURFACES}
    return out


def decayed_means(rows: DataFrame, decays: dict[str, tuple[Column, Column, int]] | None = None, cap: int = CAP, by: list[str] = ORDER) -> DataFrame:
    """``rows`` with, for each decay, ``<name>`` (weighted mean, null without a value) and ``<name>_n`` (sum of weights).

    A mean covers the player's last ``cap`` clean matches before the day; of those, the ones that
    pass the decay's filter and have a value; each weighs 2 ** (-days ago / half-life). As the weight
    at any day is the weight at the player's first day times a common factor, sums up to a match minus sums up to the
    match ``cap`` before give every mean: one shuffle by player, and a constant cost per row however
    long a player's history is. ``by`` is the order of the matches.
    """
    decays = decays or decays_of_features()
    # Places among clean matches only; other rows stand apart and carry nothing.
    order = Window.partitionBy("player", "is_clean").orderBy(*by)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("player").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    epoch = F.col("epoch")  # the player's first day: keeps the powers small
    rows = rows.withColumn("epoch", F.min("day").over(Window.partitionBy("player")))
    sums: dict[str, Column] = {}
    for name, (value, counts, half) in decays.items():
        weight = F.when(F.col("is_clean") & counts & value.isNotNull(), F.pow(F.lit(2.0), (F.col("day") - epoch) / F.lit(float(half))))
        sums[f"{name}_v"], sums[f"{name}_w"] = F.coalesce(weight * value, F.lit(0.0)), F.coalesce(weight, F.lit(0.0))
    both = rows.withColumns(sums).withColumns({k: F.sum(k).over(so_far) for k in sums} | {"place": F.row_number().over(order)})
    state = F.struct("place", *[(F.col(k) - F.coalesce(F.lag(k, cap).over(order), F.lit(0.0))).alias(k) for k in sums])
    both = both.withColumn("state", F.when(F.col("is_clean"), state)).drop("place", *sums)
    both = both.withColumn("past", F.max("state").over(before))
    out = {}
    for name, (_, _, half) in decays.items():
        v, w = F.col(f"past.{name}_v"), F.col(f"past.{name}_w")
        some = w > 0  # exactly 0 if nothing was added since the match ``cap`` before
        out[name] = F.when(some, v / w)
        out[f"{name}_n"] = F.when(some, w * F.pow(F.lit(2.0), (epoch - F.col("day")) / F.lit(float(half)))).otherwise(F.lit(0.0))
    return both.withColumns(out).drop("state", "past", "epoch")
