"""Raw results to canonical matches: one schema, cleaned values, duplicates dropped in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.functions.dates import clean_id, usable_date
from rallyframe.functions.names import normalize_name
from rallyframe.functions.scalars import INDOOR, OUTDOOR, clean_surface, finite, level_role, round_day, round_order

STATS = ("ace", "df", "svpt", "1stin", "1stwon", "2ndwon", "svgms", "bpsaved", "bpfaced")
REQUIRED = ("tourney_id", "tourney_name", "tourney_level", "tourney_date", "winner_name", "loser_name", "surface", "round")
#: The order of matches in time, ties included.
ORDER = ("tourney_date", "round_order", "match_num", "winner_key", "loser_key")


def _optional(df: DataFrame, name: str) -> Column:
    """A column of a raw table whatever the case of its name, null if the table lacks it."""
    found = next((c for c in df.columns if c.lower() == name), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def canonical_matches(raw: DataFrame, source_kind: str | Column = "main", source_file: str | Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Raw results in the canonical schema, one row per usable raw row.

    Rows without a usable date or a name, and rows of a player against themselves, are dropped.
    Missing numbers stay null (never NaN); optional columns that the table lacks are null; extra
    columns are dropped but for those in ``keep``. A player's key is the id without a trailing
    ``.0``, or ``name:`` and the normalized name where there is no id. Repeated rows are kept.
    """
    missing = [c for c in REQUIRED if not any(x.lower() == c for x in raw.columns)]
    if missing:
        raise ValueError(f"missing required columns {missing}")
    col = lambda c: _optional(raw, c)
    kind = F.lit(source_kind) if isinstance(source_kind, str) else source_kind
    file = F.lit(source_file).cast("string") if isinstance(source_file, str) else source_file if source_file is not None else col("source_file")
    text = lambda c: F.upper(F.coalesce(c.cast("string"), F.lit("")))
    indoor = F.trim(F.lower(F.coalesce(col("indoor").cast("string"), F.lit(""))))
    day, code, score = usable_date(col("tourney_date").cast("string")), text(col("round")), F.coalesce(col("score"), F.lit(""))
    sides = []
    for s in ("winner", "loser"):
        ident = clean_id(col(f"{s}_id").cast("string"))
        keyed = F.when(~ident.isin("nan", "None"), ident)
        sides += [ident.alias(f"{s}_id"), col(f"{s}_name").alias(f"{s}_name"), F.coalesce(keyed, F.concat(F.lit("name:"), normalize_name(F.when(keyed.isNull(), col(f"{s}_name"))))).alias(f"{s}_key")]
        sides += [finite(col(f"{s}_{c}")).alias(f"{s}_{c}") for c in ("age", "ht", "rank", "rank_points")] + [text(col(f"{s}_entry")).alias(f"{s}_entry")]
    out = raw.select(
        *keep, file.alias("source_file"), kind.alias("source_kind"), col("tourney_id").cast("string").alias("tourney_id"), col("tourney_name").alias("tourney_name"),
        clean_surface(col("surface")).alias("surface"), indoor.isin(*INDOOR, *OUTDOOR).cast("double").alias("indoor_known"), indoor.isin(*INDOOR).cast("double").alias("indoor_flag"),
        text(col("tourney_level")).alias("tourney_level"), level_role(kind, col("tourney_level")).alias("level_role"), day.alias("tourney_date"), code.alias("round"),
        round_order(code).alias("round_order"), F.date_add(day, round_day(code)).alias("proxy_date"), finite(col("match_num"), 0.0).alias("match_num"),
        finite(col("best_of"), 3.0).alias("best_of"), finite(col("minutes")).alias("minutes"), *sides,
        *[finite(col(f"{p}_{c}")).alias(f"{p}_{c}") for p in ("w", "l") for c in STATS], score.alias("score"),
        F.upper(score).rlike(r"\bRET\b|\bDEF\b").alias("is_retirement"), F.upper(score).rlike("W/O|WALKOVER").alias("is_walkover"),
    )
    clean = ~(F.col("is_retirement") | F.col("is_walkover"))
    out = out.withColumns({"is_clean": clean, "is_target": ((F.col("tourney_level") == "C") | (F.col("level_role") == "challenger")) & clean})
    return out.where("tourney_date is not null and winner_name is not null and loser_name is not null and winner_key <> loser_key")


def keep_first(df: DataFrame, identity: list[str], order: list[str | Column]) -> DataFrame:
    """One row per ``identity`` (nulls equal), the first by ``order``; ``order`` must be total for a fixed result.

    The first row is found by a minimum over structs, with partial results before the shuffle, so an
    identity that holds a third of the rows costs one row per task.
    """
    rest = [c for c in df.columns if c not in identity]
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    first = F.min(F.struct(*[k.alias(f"o{i}__") for i, k in enumerate(keys)], *rest)).alias("x__")
    return df.groupBy(*identity).agg(first).select(*[F.col(c) if c in identity else F.col(f"x__.`{c}`").alias(c) for c in df.columns])


def with_sequence(df: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """The place of each row within its ``by`` group, in ``order``."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_wins_union(frames: list[DataFrame], identity: list[str], order: list[str]) -> DataFrame:
    """The union of several sources by name; of rows with one identity the first source's, then the first by ``order``."""
    both = None
    for i, df in enumerate(frames):
        df = df.withColumn("source__", F.lit(i))
        both = df if both is None else both.unionByName(df, allowMissingColumns=True)
    return keep_first(both, identity, ["source__", *order]).drop("source__")


def main_draw_targets(matches: DataFrame, rounds: tuple[str, ...] = ("Q1", "Q2", "Q3", "Q4")) -> DataFrame:
    """``matches`` with ``is_target`` false in qualifying ``rounds``; such matches still feed the history."""
    return matches.withColumn("is_target", F.col("is_target") & ~F.upper(F.trim("round")).isin(*rounds))


def rounds_by_event(matches: DataFrame) -> DataFrame:
    """The distinct rounds of each event, sorted: at most the number of round codes, however many matches."""
    return matches.groupBy("tourney_id", "tourney_date").agg(F.sort_array(F.collect_set(F.upper(F.trim("round")))).alias("rounds"))
