import pytest

from rallyframe.functions import scalars as s
from rallyframe.functions.names import full_anchor, full_signatures, normalized, short_anchor, short_signature
from rallyframe.functions.similarity import event_ratio, short_name_similarity
from rallyframe.operators.matches import canonical_matches, first_wins_union, keep_first
from rallyframe.sources.results import BY_TOUR, canonical_quotes, read_results_folder
from rallyframe.sources.sinks import append_new, read_report, systematic_sample, write_report
from pyspark.sql import functions as F


def test_normalized_names():
    assert normalized("  Ána  O’Neil Jr.") == "ana o neil" and normalized("Ana Jr. ") == "ana jr"
    assert normalized("Müller-Straße") == "muller strasse"
    assert normalized(None) == "" and normalized("...") == ""


def test_anchors_and_signatures(spark):
    df = spark.createDataFrame([("ugo carabelli c",), ("carabelli",), ("de la o",), ("",)], "n string")
    rows = df.select(full_anchor(F.col("n")), short_anchor(F.col("n")), short_signature(F.col("n")), full_signatures(F.col("n"))).collect()
    assert [r[0] for r in rows] == ["c", "carabelli", "o", ""]
    assert [r[1] for r in rows] == ["carabelli", "carabelli", "la", ""]
    assert [r[2] for r in rows] == ["ugo carabelli::c", "carabelli::", "de la::o", "::"]
    assert rows[0][3] == ["c::u", "carabelli c::u", "ugo carabelli c::u"] and rows[3][3] == []


def test_similarities():
    assert event_ratio("Lyon Challenger", "lyon challenger") == 1.0 and event_ratio("", "x") == 0.0
    assert short_name_similarity("Camilo Ugo Carabelli", "Ugo Carabelli C.") == pytest.approx(1.0)
    assert short_name_similarity("Ana Bo", "Bo Ana") < 1.0


def test_scalars(spark):
    df = spark.createDataFrame([("6-4 3-6 7-6(5)",), ("6-4 2-1 RET",), ("W/O",), ("7-6(8) 6-4 [10-7]",), ("",), (None,), ("6-6",), ("99999999999-1 6-4",)], "score string")
    sets, games = s.score_shares("score")
    got = [tuple(r) for r in df.select(sets, games).collect()]
    assert got[0] == (2 / 3, 16 / 32) and got[1] == (1.0, 8 / 13) and got[2] == (None, None)
    assert got[3] == (1.0, 13 / 23) and got[4] == got[5] == (None, None) and got[6] == (None, 0.5) and got[7] == (1.0, 0.6)
    one = spark.createDataFrame([(float("nan"), "X9", 0.0)], "a double, r string, z double")
    r = one.select(s.finite("a", 7.0), s.round_order("r"), s.round_day("r"), s.rank_seed("z"), s.expected_score(F.lit(0.0)), s.comma_number(F.lit("1,85")), s.comma_number(F.lit("0.9"))).first()
    assert tuple(r) == (7.0, 6, 2, 1500.0, 0.5, 1.85, None)


RAW = "tourney_id string, tourney_name string, tourney_level string, tourney_date string, winner_name string, loser_name string, surface string, round string, winner_id string, loser_id string, SCORE string, k int"


def test_canonical_rows_defaults_and_dropped_rows(spark):
    rows = [
        ("t", "T", "c", "20240101", "Ana", "Bo", "hard", "q1", "7.0", None, None, 1), ("t", "T", None, "20240230", "Ana", "Bo", None, None, "1", "2", "x", 2),
        ("t", "T", "A", "20240101", "Ana", "Ana", "Clay", "F", None, None, "W/O", 3), ("t", "T", "A", "20240101", "Ana", None, "Clay", "F", "1", "2", "", 4), ("t", "T", "A", None, "A", "B", "Clay", "F", "1", "2", "", 5),
    ]
    got = canonical_matches(spark.createDataFrame(rows, RAW), keep=("k",)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.winner_key, r.loser_key, r.surface, r.round_order, str(r.proxy_date), r.match_num, r.best_of, r.level_role, r.is_target, r.k) == ("7", "name:bo", "Hard", 0, "2024-01-01", 0.0, 3.0, "challenger", True, 1)
    with pytest.raises(ValueError):
        canonical_matches(spark.createDataFrame(rows, RAW).drop("round"))


def test_keep_first_is_fixed_and_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(None, 3, "c"), (None, 1, None), ("x", 2, "b"), ("x", 2, "a")], "k string, o int, v string")
    assert sorted(map(tuple, keep_first(df, ["k"], ["o", "v"]).collect()), key=str) == [("x", 2, "a"), (None, 1, None)]
    assert keep_first(df.limit(0), ["k"], ["o"]).count() == 0
    both = first_wins_union([df.where("o = 3"), df.withColumn("extra", F.lit(1))], ["k"], ["o", "v"])
    assert sorted((r.k or "", r.o) for r in both.collect()) == [("", 3), ("x", 2)]


def test_folder_layout_and_first_source_wins(spark, tmp_path):
    head = "tourney_id,tourney_name,tourney_level,tourney_date,winner_name,loser_name,surface,round\n"
    (tmp_path / "2024.csv").write_text(head + "t,T,A,20240101,Ana,Bo,Hard,F\n")
    (tmp_path / "2024_challenger.csv").write_text(head + "t,T,C,20240101,Ana,Bo,Hard,F\nu,U,C,20240108,Bo,Ana,Clay,SF\n")
    got = read_results_folder(spark, str(tmp_path), [2023, 2024], BY_TOUR).collect()
    assert sorted((r.tourney_id, r.source_kind, r.source_file) for r in got) == [("t", "main", "2024.csv"), ("u", "challenger", "2024_challenger.csv")]
    with pytest.raises(FileNotFoundError):
        read_results_folder(spark, str(tmp_path), [1999])


def test_quotes_with_mapped_columns(spark):
    df = spark.createDataFrame([("2024-01-05 10:00", "Ana", "Bo", "1.5", "2.5", "CLAY"), ("x", "a", "b", "2", "2", None), ("2024-01-05", "a", None, "1.0", "3", ""), ("2024-01-05", "a", "b", None, "3", "")], "d string, a string, b string, o1 string, o2 string, surface string")
    got = canonical_quotes(df, {"date": "d", "player1": "a", "player2": "b", "odd1": "o1", "odd2": "o2"}).collect()
    assert [(str(r.date), r.odd1, r.surface, r.player1_key_name) for r in got] == [("2024-01-05", 1.5, "Clay", "ana")]


def test_append_is_idempotent_and_reports_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert append_new(df, path, ["k"]).count() == 3
    assert append_new(df.where("k is not null"), path, ["k"]).count() == 0
    assert spark.read.parquet(path).count() == 3
    write_report({"x": float("nan"), "d": __import__("datetime").date(2024, 1, 1)}, str(tmp_path / "r.json"))
    assert read_report(str(tmp_path / "r.json")) == {"x": None, "d": "2024-01-01"}
    assert sorted(r[0] for r in systematic_sample(spark.range(25).repartition(3), ["id"], 10).collect()) == [0, 10, 20]
    assert systematic_sample(spark.range(0), ["id"], 3).count() == 0
