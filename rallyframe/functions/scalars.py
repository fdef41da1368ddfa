"""Scalar expressions of the match data: rounds, surfaces, roles, scores, rates and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Order of the rounds, and the day of its event on which a round is taken to be played.
ROUND_ORDER = {"Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3, "R128": 4, "R64": 5, "R32": 6, "R16": 7, "QF": 8, "SF": 9, "F": 10, "RR": 7, "BR": 11}
ROUND_DAY = {"R128": 0, "R64": 1, "R32": 2, "R16": 3, "QF": 4, "SF": 5, "F": 6, "RR": 2, "BR": 6, "Q1": 0, "Q2": 1, "Q3": 2, "Q4": 3}
OTHER_ROUND = 6
SURFACES = ("Hard", "Clay", "Grass", "Carpet", "Unknown")
ROLES = ("challenger", "main", "tour_qual", "futures")
INDOOR = {"yes", "true", "1", "indoor"}
OUTDOOR = {"no", "false", "0", "outdoor"}


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column, table: dict[str, int], default: Column | int) -> Column:
    """A small fixed table as an expression; unknown and null texts give the default."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default) if isinstance(default, int) else default)


def finite(c: str | Column, default: Column | float | None = None) -> Column:
    """A number, or the default if it is null, no number, NaN or infinite."""
    x = _col(c).try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    if default is None:
        return x
    return F.coalesce(x, default if isinstance(default, Column) else F.lit(float(default)))


def round_order(code: str | Column) -> Column:
    return lookup(F.upper(_col(code)), ROUND_ORDER, OTHER_ROUND)


def round_day(code: str | Column) -> Column:
    """Days from an event's start to a round: fixed for known rounds, 6 for other codes that begin with Q, else 2."""
    c = F.upper(F.trim(F.coalesce(_col(code), F.lit(""))))
    return lookup(c, ROUND_DAY, F.when(c.startswith("Q"), F.lit(OTHER_ROUND)).otherwise(F.lit(OTHER_ROUND - 4)))


def clean_surface(c: str | Column) -> Column:
    s = F.initcap(F.trim(_col(c)))
    return F.when(s.isin(*SURFACES), s).otherwise(F.lit("Unknown"))


def level_role(kind: str | Column, level: str | Column) -> Column:
    """The role of a match by the kind of its file and its level."""
    # Kinds and levels with their roles.
    kind, level = _col(kind), F.upper(F.coalesce(_col(level), F.lit("")))
    return (
        F.when(kind == "challenger", "challenger")
        .when(kind.isin("qual_chall", "tour_qual"), F.when(level == "C", "challenger").otherwise("tour_qual"))
        .when(kind.isin("futures", "itf"), "futures")
        .when(level == "C", "challenger")
        .otherwise("main")
    )


def score_shares(score: str | Column) -> tuple[Column, Column]:
    """The winner's shares of sets and of games; null for walkovers and scores without finished sets or games."""
    text = F.upper(F.trim(F.coalesce(_col(score), F.lit(""))))
    bare = F.regexp_replace(F.replace(F.replace(text, F.lit("RET"), F.lit("")), F.lit("DEF"), F.lit("")), r"\s+", " ")
    sets = F.transform(F.filter(F.split(bare, " "), lambda t: ~t.startswith("[")), lambda t: F.regexp_replace(t, r"\([^)]*\)", ""))
    sets = F.transform(F.filter(sets, lambda t: t.rlike("^[0-9]{1,9}-[0-9]{1,9}$")), lambda t: F.transform(F.split(t, "-"), lambda x: x.cast("int")))
    add = lambda f: F.aggregate(sets, F.lit(0), lambda a, s: a + f(s))
    won, lost = add(lambda s: (s[0] > s[1]).cast("int")), add(lambda s: (s[0] < s[1]).cast("int"))
    games, other = add(lambda s: s[0]), add(lambda s: s[1])
    played = ~text.contains("W/O") & ~text.contains("WALKOVER")
    share = lambda a, b: F.when(played, F.try_divide(a.cast("double"), a + b))
    return share(won, lost), share(games, other)


def match_rates() -> dict[str, Column]:
    """Serve, return, hold and break rates, and shares of sets and games, of both sides of a canonical match."""
    out: dict[str, Column] = {}
    for me in ("w", "l"):
        won = finite(f"{me}_1stwon") + finite(f"{me}_2ndwon")
        out[f"{me}_spw"] = F.try_divide(won, finite(f"{me}_svpt"))
        out[f"{me}_broken"] = F.try_divide(finite(f"{me}_bpfaced") - finite(f"{me}_bpsaved"), finite(f"{me}_svgms"))
    for me, you in (("w", "l"), ("l", "w")):
        out[f"{me}_rpw"] = 1.0 - out[f"{you}_spw"]
        out[f"{me}_hold"] = 1.0 - out[f"{me}_broken"]
        out[f"{me}_break"] = out[f"{you}_broken"]
    sets, games = score_shares("score")
    out |= {"w_set_share": sets, "l_set_share": 1.0 - sets, "w_game_share": games, "l_game_share": 1.0 - games}
    return {k: v for k, v in out.items() if not k.endswith("_broken")}


def expected_score(difference: str | Column, scale: float = 400.0) -> Column:
    """Expected score of a rating difference."""
    return 1.0 / (1.0 + F.pow(F.lit(10.0), -_col(difference) / F.lit(scale)))


def rank_seed(rank: str | Column, base: float = 1500.0, strength: float = 0.45) -> Column:
    """A first rating, drawn from the base towards the rating that a rank stands for."""
    r = finite(rank)
    raw = F.least(F.greatest(2000.0 - 250.0 * F.log10(r), F.lit(1150.0)), F.lit(2050.0))
    return F.when(r > 0, F.lit(base) + F.lit(strength) * (raw - F.lit(base))).otherwise(F.lit(base))


def logit(p: str | Column, clip: float = 1e-5) -> Column:
    """The logit of a probability kept ``clip`` from 0 and 1; null stays null."""
    x = F.when(_col(p).isNotNull(), F.least(F.greatest(_col(p), F.lit(clip)), F.lit(1 - clip)))
    return F.ln(x / (1.0 - x))


def expit(x: str | Column) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(x)))


def two_way_probability(odd_a: str | Column, odd_b: str | Column) -> Column:
    """The first side's share of the two inverse quotes."""
    a, b = F.try_divide(F.lit(1.0), _col(odd_a)), F.try_divide(F.lit(1.0), _col(odd_b))
    return F.try_divide(a, a + b)


def month(c: str | Column) -> Column:
    return F.date_format(_col(c), "yyyy-MM")


def entry_flags(entry: str | Column) -> dict[str, Column]:
    e = F.upper(F.coalesce(_col(entry), F.lit("")))
    groups = {"q": ("Q", "Q1", "Q2", "Q3"), "wc": ("WC",), "ll": ("LL",), "pr": ("PR", "P")}
    return {k: e.isin(*v).cast("double") for k, v in groups.items()}


def squeeze(c: str | Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def comma_number(c: str | Column, above: float = 1.0) -> Column:
    """A number written with a decimal comma or point, null unless it is larger than ``above``."""
    x = F.replace(F.trim(_col(c)), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(x > above, x)
