import re
import unicodedata
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rallyframe.llm import canonical as c

SCHEMA = "row_id long, name string, round string, n double, note string, k__ string"
ROWS = [
    (5, "Ana Bo", "R16", 1.0, None, "a"), (3, " BO,  ana ", "[r.1.6.]", 1.0, None, "a"), (9, "Ana-Bo", "R 16", 1.0, None, "a"), (4, "Ána Bo", "R16", 1.0, None, "a"), (6, "Ana Bo", "R16", None, None, "a"),
    (13, "Y Li", "SF", 2.0, None, "b"), (14, "Li, Y.", "F.S.", 2.0, None, "b"), (15, "Il Y", "SF", 2.0, None, "b"),
    (7, "Bo Ana", "r-16", float("nan"), None, "a"), (8, None, None, 0.0, "", "a"), (2, None, None, -0.0, "", "a"), (1, "", None, 0.0, "", "a"), (10, "Aan Bo", "R16", 1.0, None, "a"), (11, "x" * 100_000, "F", 1.0, None, "a"), (12, "X" * 100_000 + ".", "f", 1.0, None, "a"), (5, "Ana Bo", "R16", 1.0, None, "a"),
]


def test_groups_and_copies(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    groups = {(r.first_row_id, r.copies) for r in c.canonical_groups(df, "row_id", ["name", "round"], ["k__"], ["round"]).collect()}
    assert groups == {(3, 4), (4, 1), (6, 2), (2, 2), (1, 1), (10, 1), (11, 2), (13, 2), (15, 1)}
    pairs = {tuple(r) for r in c.canonical_copies(df, "row_id", ["name", "round"], ["k__"], ["round"]).collect()}
    assert pairs == {(3, 5), (3, 9), (6, 7), (2, 8), (11, 12), (13, 14)}
    assert c.canonical_copies(df.limit(0), "row_id", ["name"], []).count() == 0


def test_a_hot_group_is_salted_to_the_same_result(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "Hot Name").otherwise(F.concat(F.lit("n"), (F.col("id") % 700).cast("string"))).alias("name"))
    plain = sorted(map(tuple, c.canonical_copies(df, "row_id", ["name"], []).collect()))
    monkeypatch.setattr(c, "HOT_ROWS", 100)
    assert sorted(map(tuple, c.canonical_copies(df, "row_id", ["name"], []).collect())) == plain
    assert sorted(map(tuple, c.canonical_groups(df, "row_id", ["name"], []).collect()))[0] == (0, 1000)


def brute(s, code):
    if s is None:
        return None
    ws = re.findall(r"[^\W_]+", re.sub(f"[{c.APOSTROPHES}]", "", s.lower()))
    return "".join(sorted("".join(ws) if code else ws))


@pytest.mark.parametrize("code", [False, True])
@pytest.mark.parametrize("text", ["St. Émile  Open", "O'Neil-Smith", "Q-1", "Li Fu", "Fu, Li", "S.F.", "(R.3.2.)", "", "...", None, "a_b C d", "II, Bad Y", "Y Li"])
def test_canonical_text(spark, text, code):
    got = spark.createDataFrame([(text,)], "t string").select(c.canonical_text("t", code)).first()[0]
    assert got == brute(text, code)
