from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import models
from rallyframe.operators.features import DIFF_FEATURES

X = ["elo_slow_diff_100", "elo_dynamic_surface_blend_diff_100"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 2))
    y = (rng.random(900) < 1 / (1 + np.exp(-1.5 * x[:, 0]))).astype(int)
    rows = [(i, date(2023, 1, 1) + timedelta(days=i // 3), float(a), float(b), int(t), 5.0, 5.0, 0.5) for i, ((a, b), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"row_id long, date date, {X[0]} double, {X[1]} double, target int, min_experience double, min_surface_experience double, stat_coverage double").cache(), x, y


def newton(z, y, l2, offset=0.0):
    z = np.column_stack([np.ones(len(z)), z])
    b = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-(offset + z @ b)))
        pen = np.r_[0, np.full(len(b) - 1, l2)]
        b -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(pen), z.T @ (p - y) + pen * b)
    return b


def test_logistic_equals_newton_on_one_machine(frame):
    df, x, y = frame
    m = models.Logistic(X, 4.5).fit(df)
    z = (x - x.mean(0)) / x.std(0)
    assert m.beta == pytest.approx(newton(z, y, 4.5), abs=1e-6)
    again = models.Logistic.from_json(m.to_json())
    a, b = [[r.p for r in k.predict(df, "p").orderBy("row_id").collect()] for k in (m, again)]
    assert a == b


def test_offset_is_fixed(frame):
    df, x, y = frame
    m = models.Logistic([X[1]], 18.0, "off").fit(df.withColumn("off", F.col(X[0]) * 2.0))
    z = ((x[:, 1] - x[:, 1].mean()) / x[:, 1].std())[:, None]
    assert m.beta == pytest.approx(newton(z, y, 18.0, 2 * x[:, 0]), abs=1e-6)


def test_symmetric_prediction_and_blocks(frame):
    df, *_ = frame
    m = models.Logistic(X, 4.5).fit(df)
    p = models.symmetric_predict(m, df, "p")
    flip = models.symmetric_predict(m, df.withColumns({c: -F.col(c) for c in X if c in DIFF_FEATURES}), "q")
    assert p.join(flip, "row_id").agg(F.max(F.abs(F.col("p") + F.col("q") - 1.0))).first()[0] < 1e-9
    blocks = models.validation_blocks(df, 100, 50, 200, 30)
    assert blocks[0] == (date(2023, 4, 11), date(2023, 5, 31), 300, 150) and len(blocks) == 4
    assert models.validation_blocks(df.limit(0), 100) == []


def test_blend_weights_are_bounded_and_prefer_the_better_model(frame, spark):
    df, x, y = frame
    good = df.withColumns({"p_a": 1 / (1 + F.exp(-1.5 * F.col(X[0]))), "p_b": F.lit(0.5)})
    w = models.blend_weights(good, ["p_a", "p_b"])
    assert w.sum() == pytest.approx(1) and w[0] > 0.7 and w.min() >= 0.03
    assert models.blend_weights(good.limit(10), ["p_a", "p_b"]).tolist() == [0.5, 0.5]
    c = models.Calibrator().fit(good.limit(20), "p_a")
    assert c.model is None and c.predict(good, "p_a", "q").where("abs(q - p_a) > 1e-4").count() == 0


def test_walk_forward_uses_the_past_only(frame):
    df, *_ = frame
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)}
    run = lambda d: {r.row_id: r for r in models.walk_forward(d, 100, 50, 200, 30, make).where("fold_id = 0").collect()}
    base = run(df)
    later = run(df.withColumn("target", F.when(F.col("date") >= F.lit(date(2023, 4, 11)), 1 - F.col("target")).otherwise(F.col("target"))))
    assert base and {k: r.predicted_probability for k, r in base.items()} == {k: r.predicted_probability for k, r in later.items()}
    with pytest.raises(ValueError):
        models.walk_forward(df, 5000)


@pytest.mark.parametrize(("kind", "options"), [("forest", {"numTrees": 5}), ("boost", {"maxIter": 4})])
def test_trees_fit_and_score(frame, kind, options):
    df, *_ = frame
    t = models.Trees(X, kind, {"maxDepth": 3, "seed": 1} | options).fit(df)
    p = t.predict(df, "p")
    assert set(p.columns) == {*df.columns, "p"} and p.where("p between 0 and 1").count() == 900


def test_ensembles_survive_saving(frame, spark, tmp_path):
    df, *_ = frame
    parts = {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5).fit(df), "forest": models.Trees(X, "forest", {"numTrees": 3, "maxDepth": 2, "seed": 1}).fit(df)}
    e = models.Ensemble(parts, np.array([0.2, 0.5, 0.3]), models.Calibrator(least=10).fit(parts["logistic"].predict(df, "p"), "p"))
    e.save(spark, str(tmp_path / "e"))
    again = models.Ensemble.load(spark, str(tmp_path / "e"))
    a, b = [{r.row_id: r.predicted_probability for r in x.predict(df).collect()} for x in (e, again)]
    assert a == pytest.approx(b) and len(a) == 900


def test_gaps_to_a_reference_and_the_saved_offset_model(frame, spark, tmp_path):
    df, x, y = frame
    rows = df.withColumns({"predicted_probability": 1 / (1 + F.exp(-F.col(X[0]))), "market_probability_a": F.when(F.col("row_id") % 50 > 0, F.lit(0.5)), "reliability": F.lit(None).cast("double")})
    gaps = models.with_reference_gaps(rows)
    a, b = gaps.where("row_id = 1").first(), gaps.where("row_id = 50").first()
    assert a.fund_market_logit_gap == pytest.approx(x[1, 0]) and a.fund_market_prob_gap == pytest.approx(a.predicted_probability - 0.5) and a.reliability_centered == -0.5 and a.min_experience_log == pytest.approx(np.log(6.0))
    assert b.fund_market_logit_gap is None and b.fund_market_prob_gap is None
    cols = ["fund_market_logit_gap", "min_experience_log"]
    gaps = gaps.withColumn("market_logit_a", F.lit(0.0))
    m = models.OffsetModel.fit(gaps, cols)
    m.save(spark, str(tmp_path / "offset"))
    back = models.OffsetModel.load(spark, str(tmp_path / "offset"))
    p, q = [[r.value_probability for r in k.predict(gaps).orderBy("row_id").collect()] for k in (m, back)]
    assert p == q and back.rows == 900
    folds = gaps.withColumn("fold_id", (F.col("row_id") / 300).cast("int"))
    out = {r.row_id: r for r in models.walk_forward_offset(folds, cols, "market_logit_a", "market_probability_a", least=350).collect()}
    assert out[1].value_probability == out[301].value_probability == 0.5 and out[899].value_probability != 0.5
    first = models.OffsetModel.fit(folds.where("fold_id < 2"), cols).predict(folds).where("row_id = 899").first()
    assert out[899].value_probability == pytest.approx(first.value_probability)


def test_horizons_and_the_final_ensemble(frame):
    df, *_ = frame
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)}
    best, rows = models.compare_horizons(df, [60, 100], block=50, min_train=100, min_test=30, make=make)
    assert best == rows[0]["horizon_days"] and [r["selection_score"] for r in rows] == sorted(r["selection_score"] for r in rows)
    for r in rows:
        assert r["selection_score"] == pytest.approx(r["log_loss"] + 0.12 * r["fold_log_loss_std"] + 0.2 * r["brier"])
    oof = models.walk_forward(df, best, 50, 100, 30, make)
    final = models.fit_final(df, oof, best, date(2023, 9, 1), make)
    p = final.predict(df.where("date >= '2023-09-01'"))
    assert p.count() > 0 and p.where("predicted_probability between 0 and 1").count() == p.count() and final.weights.sum() == pytest.approx(1)


def test_folds_fitted_together_equal_fits_one_by_one(frame):
    df, *_ = frame
    df = df.withColumn(X[0], F.when(F.col("row_id") % 7 > 0, F.col(X[0])))
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)}
    oof = models.walk_forward(df, 100, 50, 200, 30, make).cache()
    blocks = models.validation_blocks(df, 100, 50, 200, 30)
    start, end = blocks[-1][:2]
    train = models.augment_symmetric(df.where((F.col("date") >= F.lit(start - timedelta(days=100))) & (F.col("date") < F.lit(start))))
    one, together = models.Logistic(X, 4.5).fit(train), models.Logistic(X, 4.5)
    day = lambda d: (d - date(1970, 1, 1)).days
    models.fit_windows([models.Logistic(X, 4.5), together], df, F.unix_date("date"), [(day(date(2023, 1, 1)), day(start)), (day(start) - 100, day(start))], mirrored=True)
    assert together.beta == pytest.approx(one.beta, abs=1e-8) and together.prepared[X[0]] == pytest.approx(one.prepared[X[0]], abs=1e-9)
    past, names = oof.where(F.col("fold_id") < len(blocks) - 1), ["p_rating", "p_logistic"]
    last = models.Ensemble({"rating": models.RatingBaseline(), "logistic": one}, models.blend_weights(past, names), models.Calibrator().fit(past, "ensemble_raw"))
    want = {r.row_id: (r.ensemble_raw, r.predicted_probability) for r in last.predict(df.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))).collect()}
    got = {r.row_id: (r.ensemble_raw, r.predicted_probability) for r in oof.where(F.col("fold_id") == len(blocks) - 1).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-7) for i in want)


def test_blend_weights_are_the_least_of_their_loss(frame):
    df, x, y = frame
    p = np.column_stack([1 / (1 + np.exp(-0.7 * x[:, 0])), 1 / (1 + np.exp(-x[:, 0] - x[:, 1]))])
    good = df.withColumns({"p_a": 1 / (1 + F.exp(-0.7 * F.col(X[0]))), "p_b": 1 / (1 + F.exp(-F.col(X[0]) - F.col(X[1])))})
    w = models.blend_weights(good, ["p_a", "p_b"], shrink=0.0)
    grid = np.arange(0.03, 0.85, 1e-5)
    loss = []
    for g in grid:
        q = p @ [g, 1 - g]
        loss.append(-(y * np.log(q) + (1 - y) * np.log(1 - q)).mean() + 0.08 * 2 * (g - 0.5) ** 2)
    assert w[0] == pytest.approx(grid[np.argmin(loss)], abs=2e-5)


def test_folds_are_staged_in_few_files(frame, spark):
    df, *_ = frame
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)}
    oof = models.walk_forward(df.repartition(4), 100, 50, 200, 30, make)
    assert len(oof.inputFiles()) <= 4 and oof.select("fold_id").distinct().count() == 4


def test_trees_of_one_fold_share_their_medians(frame, monkeypatch):
    df, *_ = frame
    fits, own = [], models.Imputer
    monkeypatch.setattr(models, "Imputer", lambda **o: fits.append(o) or own(**o))
    trees = {n: models.Trees(X, k, {"maxDepth": 2, "seed": 1} | o) for n, k, o in (("forest", "forest", {"numTrees": 2}), ("boost", "boost", {"maxIter": 2}))}
    oof = models.walk_forward(df, 100, 150, 200, 30, lambda n, seed: dict(trees))
    assert len(fits) == oof.select("fold_id").distinct().count()
    assert oof.where("p_forest between 0 and 1 and p_boost between 0 and 1").count() == oof.count() > 0
