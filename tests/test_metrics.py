import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import metrics, selection
from rallyframe.operators.validation import require_rows, validate_weeks


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), int(rng.random() < 0.6), round(rng.random(), 1), i) for i in range(300)] + [("a", None, 0.5, 900), ("b", 1, None, 901), ("b", 0, float("nan"), 902), ("c", 1, 0.9, 903)]
    return spark.createDataFrame(rows, "g string, y int, p double, i int"), [r for r in rows if r[1] is not None and r[2] is not None and r[2] == r[2]]


def test_grouped_metrics_match_definitions(scored):
    df, rows = scored
    for r in metrics.grouped_metrics(df, ["g"], "y", "p").collect():
        own = [(y, min(max(p, 1e-6), 1 - 1e-6)) for g, y, p, _ in rows if g == r.g]
        assert r.n == len(own) and r.accuracy == pytest.approx(np.mean([(p >= 0.5) == (y == 1) for y, p in own]))
        assert r.brier == pytest.approx(np.mean([(y - p) ** 2 for y, p in own])) and r.log_loss == pytest.approx(-np.mean([math.log(p if y else 1 - p) for y, p in own]))
        pos, neg = [p for y, p in own if y], [p for y, p in own if not y]
        if pos and neg:
            assert r.auc == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))
        else:
            assert r.auc is None
    assert metrics.grouped_metrics(df.limit(0), [], "y", "p").count() == 0


def test_calibration_merges_equal_edges(scored, spark):
    df, rows = scored
    got = metrics.calibration_table(df, "y", "p").collect()
    assert sum(r.n for r in got) == len(rows) and all(r.error == pytest.approx(r.win_rate - r.mean_prediction) for r in got)
    one = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, p double")
    assert [(r.n, r.win_rate) for r in metrics.calibration_table(one, "y", "p").collect()] == [(2, 0.5)]
    assert metrics.calibration_table(one.limit(0), "y", "p").count() == 0


def fall(values):
    s = peak = worst = 0.0
    for v in values:
        s += v
        peak = max(peak, s)
        worst = max(worst, peak - s)
    return worst


@pytest.mark.parametrize("period", [None, "d"])
def test_largest_fall_equals_a_plain_loop(spark, period):
    rng = random.Random(11)
    rows = [(g, i // 7, i, round(rng.uniform(-1, 1), 2)) for g in "xyz" for i in range(60)] + [("neg", 0, 0, -2.0), ("neg", 1, 1, -1.0), ("up", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "g string, d int, i int, v double")
    got = {r.g: r.largest_fall for r in metrics.largest_fall(df, ["g"], ["d", "i"], "v", period).collect()}
    for g in got:
        assert got[g] == pytest.approx(fall([v for h, _, _, v in rows if h == g]))


def test_bootstrap_is_repeatable_and_centred(spark):
    df = spark.createDataFrame([(float(i % 7),) for i in range(700)] + [(None,)], "v double")
    a, b = metrics.bootstrap_mean(df, "v", 300).first(), metrics.bootstrap_mean(df.repartition(5), "v", 300).first()
    assert tuple(a) == pytest.approx(tuple(b)) and a.p05 < a.p50 < a.p95 and a.p50 == pytest.approx(3.0, abs=0.1)
    assert tuple(metrics.bootstrap_mean(df.limit(0), "v", 10).first()) == (None, None, None)


def test_top_fraction_counts_all_rows_but_takes_eligible_ones(spark):
    df = spark.createDataFrame([("a", i, i % 2) for i in range(21)] + [("b", 1, 0), (None, 2, 1)], "g string, v int, ok int")
    got = selection.top_fraction(df, "g", [F.desc("v")], 0.1, F.col("ok") == 1).collect()
    assert sorted((r.g or "", r.v, r.cap) for r in got) == [("", 2, 1), ("a", 15, 3), ("a", 17, 3), ("a", 19, 3)]
    grid = spark.createDataFrame([("x", 0.1, 0), ("y", 0.5, 10)], "policy string, fraction double, low int")
    n = {r.policy: r["count"] for r in selection.grid_top_fraction(df, "g", [F.desc("v")], grid, F.col("v") >= F.col("low")).groupBy("policy").count().collect()}
    assert n == {"x": 5, "y": 11}


def test_choose_falls_back(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9)], "k string, n int")
    assert selection.choose(df, [(F.col("n") > 50, [F.desc("n")]), (F.lit(True), [F.asc("n")])]).first().k == "a"
    assert selection.choose(df.limit(0), [(F.lit(True), [F.asc("n")])]).count() == 0


def test_week_validation(spark):
    from datetime import date

    rows = [("t1", "C", date(2024, 1, 1), "F", True), ("t2", "C", date(2024, 1, 8), "F", True), ("t2", "C", date(2024, 1, 8), "SF", True)]
    df = spark.createDataFrame(rows, "tourney_id string, tourney_level string, tourney_date date, round string, is_target boolean").withColumn("proxy_date", F.col("tourney_date"))
    out = validate_weeks(df, date(2024, 1, 1), date(2024, 1, 14))
    assert out["targets_inside"] == 3 and out["events_in_last_week"] == 1
    for bad in ((date(2024, 1, 2), date(2024, 1, 14)), (date(2024, 1, 1), date(2024, 1, 21))):
        with pytest.raises(ValueError):
            validate_weeks(df, *bad)
    with pytest.raises(ValueError):
        validate_weeks(df.where("round <> 'F'"), date(2024, 1, 1), date(2024, 1, 14))
    with pytest.raises(ValueError):
        require_rows(df, 4, "results")


def test_bootstrap_equals_resampling_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = np.round(rng.normal(1.0, 2.0, 400), 1)
    got = metrics.bootstrap_mean(spark.createDataFrame([(float(x),) for x in v], "v double"), "v", 1500, buckets=5).first()
    want = np.percentile([rng.choice(v, 400).mean() for _ in range(3000)], [5, 50, 95])
    assert np.allclose(tuple(got), want, atol=0.03)


def test_selections_are_stored_and_grids_of_any_size_equal_single_selections(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from rallyframe.operators import selection

    rows = [(i, f"d{i % 4}", (i * 37 % 101) / 100, None if i % 11 == 0 else float(i % 5), (i % 7) - 3.0) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, slate string, p double, history double, gain double")
    s = selection.Selection("core", "slate", 0.2, ("-p", "row_id"), {"p": 0.3}, {"history": 3.0})
    s.save(spark, str(tmp_path / "s"))
    back = selection.Selection.load(spark, str(tmp_path / "s"))
    got = {r.row_id for r in back.apply(df).collect()}
    want = set()
    for d in {r[1] for r in rows}:
        own = [r for r in rows if r[1] == d]
        ok = sorted((r for r in own if r[2] >= 0.3 and r[3] is not None and r[3] <= 3), key=lambda r: (-r[2], r[0]))
        want |= {r[0] for r in ok[: max(1, -(-len(own) // 5))]}
    assert back == s and got == want
    grid = spark.createDataFrame([(f"{f}/{x}", f, x) for f in (0.1, 0.2, 0.5) for x in (0.0, 0.3)], "policy string, fraction double, floor double")
    order, ok = [F.desc("p"), F.asc("row_id")], F.col("p") >= F.col("floor")
    plain = sorted(map(tuple, selection.grid_summary(df, "slate", order, grid, ok, F.col("slate"), "gain").collect()))
    monkeypatch.setattr(selection, "GRID_ROWS", 2)
    assert sorted(map(tuple, selection.grid_summary(df, "slate", order, grid, ok, F.col("slate"), "gain").collect())) == plain and len(plain) == 6
    one = {r.row_id for r in selection.top_fraction(df, "slate", order, 0.2, F.col("p") >= 0.3).collect()}
    assert {r.row_id for r in selection.grid_top_fraction(df, "slate", order, grid, ok).where("policy = '0.2/0.3'").collect()} == one
