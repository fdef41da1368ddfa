"""Result files in the common one-file-per-year CSV layouts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.functions.names import normalize_name
from rallyframe.functions.scalars import clean_surface
from rallyframe.operators.matches import ORDER, canonical_matches, first_wins_union

# File names of the two layouts, with the kind of result that each holds.
BY_LEVEL = (("main", "atp_matches_{year}.csv"), ("qual_chall", "atp_matches_qual_chall_{year}.csv"), ("futures", "atp_matches_futures_{year}.csv"))
BY_TOUR = (("main", "{year}.csv"), ("challenger", "{year}_challenger.csv"), ("tour_qual", "atp_quali/{year}_atp_quali.csv"))


def read_csv(spark: SparkSession, path: str | list[str], multi_line: bool = False) -> DataFrame:
    """A CSV with a header, every column as text; ids and dates keep their digits, texts their blanks.

    ``multi_line`` reads quoted values with line breaks in them; a file is then one task.
    """
    return spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", enforceSchema=False, multiLine=multi_line)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_results(spark: SparkSession, path: str, source_kind: str, multi_line: bool = False) -> DataFrame:
    """One results file as canonical matches; raises if a required column is missing."""
    return canonical_matches(read_csv(spark, path, multi_line), source_kind, F.element_at(F.split(F.input_file_name(), "/"), -1))


def read_results_folder(spark: SparkSession, root: str, years: Iterable[int], layout: tuple = BY_LEVEL, identity: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """All files of a layout that exist for the years, as one table without repeated matches.

    A match that stands in several files is taken from the first in year and layout order. Its
    identity is the event's id, date, round and both players' keys, or for the layout by tour the
    event's and players' names. Raises if no file exists.
    """
    by_name = ["tourney_name", "tourney_date", "round", "winner_name", "loser_name"]
    by_key = ["tourney_id", "tourney_date", "round", "winner_key", "loser_key"]
    frames = [read_results(spark, f"{root}/{p.format(year=y)}", kind, multi_line) for y in years for kind, p in layout if exists(spark, f"{root}/{p.format(year=y)}")]
    if not frames:
        raise FileNotFoundError(f"no results under {root}")
    return first_wins_union(frames, identity or (by_name if layout is BY_TOUR else by_key), list(ORDER))


def canonical_quotes(raw: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Quotes of two players' matches in one schema: days without time, both quotes above 1, known surfaces.

    ``columns`` maps a canonical name to the source's. date, player1, player2, odd1 and odd2 are
    required; other columns are kept as they are. Rows without a day or quote are dropped.
    """
    names = {v: k for k, v in (columns or {}).items()}
    df = raw.withColumnsRenamed(names)
    missing = [c for c in ("date", "player1", "player2", "odd1", "odd2") if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    out = df.withColumns({"date": F.try_to_date(F.col("date").cast("string").substr(1, 10)), "odd1": F.col("odd1").try_cast("double"), "odd2": F.col("odd2").try_cast("double")})
    out = out.withColumns({"player1_key_name": normalize_name("player1"), "player2_key_name": normalize_name("player2")})
    if "surface" in df.columns:
        out = out.withColumn("surface", clean_surface("surface"))
    return out.where("date is not null and odd1 > 1 and odd2 > 1 and not isnan(odd1) and not isnan(odd2)")
