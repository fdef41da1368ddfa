from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyframe.operators import models, trees
from rallyframe.operators.features import FEATURES
from rallyframe.plans import match_queries as mq
from rallyframe.plans import source_queries as sq

X = ["elo_slow_diff_100", "elo_dynamic_surface_blend_diff_100", "stat_coverage"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 3)), 2)
    y = (rng.random(600) < 1 / (1 + np.exp(-1.5 * x[:, 0] - x[:, 1] * x[:, 2]))).astype(int)
    rows = [(i, date(2023, 1, 1) + timedelta(days=i // 3), *map(float, a), int(t), 5.0, 5.0) for i, (a, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, f"row_id long, date date, {X[0]} double, {X[1]} double, {X[2]} double, target int, min_experience double, min_surface_experience double").cache(), x.astype(np.float32), y.astype(float)


def prepared(x):
    edges = [trees.bin_edges(x[:, c]) for c in range(x.shape[1])]
    return np.column_stack([np.searchsorted(e, x[:, c].astype(float)) for c, e in enumerate(edges)]).astype(np.uint8), edges


def boosted(x, y, steps, rate, leaves, least, l2):
    """Plain loops over all cuts, the leaf of the greatest gain first."""
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + l2)
        parts = [np.arange(len(y))]
        while len(parts) < leaves:
            cuts = []
            for i, own in enumerate(parts):
                for c in range(x.shape[1]):
                    for v in np.unique(x[own, c])[:-1]:
                        a, b = own[x[own, c] <= v], own[x[own, c] > v]
                        if min(len(a), len(b)) >= least:
                            cuts.append((worth(a) + worth(b) - worth(own), i, a, b))
            if not cuts or max(c[0] for c in cuts) <= 0:
                break
            _, i, a, b = max(cuts, key=lambda c: c[0])
            parts[i : i + 1] = [a, b]
        for own in parts:
            raw[own] -= rate * g[own].sum() / (h[own].sum() + l2)
    return 1 / (1 + np.exp(-raw))


def test_boosting_equals_plain_loops(table):
    _, x, y = table
    x, y = np.round(x[:300], 1), y[:300]
    m = trees.Grown(X, "boost", {"trees": 3, "rate": 0.3, "leaves": 6, "least": 20, "l2": 5.0})
    m.model = m.grown(x, y, prepared(x), range(3)) | {"fill": np.zeros(3)}
    assert m.scores(x.astype(float)) == pytest.approx(boosted(x, y, 3, 0.3, 6, 20, 5.0), abs=1e-9)
    assert len(m.model["feature"]) == 3 * 11 and len(m.model["roots"]) == 3


def test_best_cut_of_a_forest_equals_plain_gini(table):
    _, x, y = table
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean())
    cuts = [(gini(y[x[:, c] <= v]) + gini(y[x[:, c] > v]), c, v) for c in range(3) for v in np.unique(x[:, c]) if 18 <= (x[:, c] <= v).sum() <= 582]
    bins, _ = prepared(x)
    gain, column, at = trees._best_cuts(bins, np.arange(600), None, np.zeros(600, np.int64), 1, y, np.ones(600), 18, 0.0)
    left = bins[:, column[0]] <= at[0]
    assert min(left.sum(), (~left).sum()) >= 18
    least = min(c[0] for c in cuts)
    assert gini(y[left]) + gini(y[~left]) == pytest.approx(least, rel=0.02) and column[0] == min(cuts)[1]


def test_extra_trees_cut_at_random(table):
    _, x, y = table
    options = {"trees": 40, "depth": 1, "least": 18, "share": 1.0, "seed": 5, "bootstrap": False}
    m = trees.Grown(X, "forest", options)
    found = m.grown(x, y, (None, []), range(40))
    roots = found["cut"][found["roots"]]
    assert len(np.unique(roots)) == 40 and np.ptp(roots) > 0.3
    other = trees.Grown(X, "forest", options).grown(x, y, (None, []), range(20, 40))
    assert np.array_equal(other["cut"][other["roots"]], roots[20:])


@pytest.mark.parametrize("kind", ["boost", "extra", "forest"])
def test_rows_looked_at_in_steps_grow_the_same_trees(table, monkeypatch, kind):
    _, x, y = table
    options = models.candidate_models(600, 5)[kind].options | {"trees": 3}
    grow = lambda: trees.Grown(X, "boost" if kind == "boost" else "forest", options).grown(x, y, prepared(x), range(3))
    whole = grow()
    monkeypatch.setattr(trees, "STEP", 70)
    steps = grow()
    assert len(whole["feature"]) > 15 and all(whole[c] == pytest.approx(steps[c]) for c in whole)


def test_windows_grow_alike_however_they_are_spread(table):
    df, *_ = table
    make = lambda: [trees.Grown(X, "boost", {"trees": 4, "rate": 0.1, "leaves": 5, "least": 20, "l2": 5.0}), trees.Grown(X[:2], "forest", {"trees": 6, "depth": 3, "least": 18, "share": 0.7, "seed": 1, "bootstrap": True})]
    day = F.datediff("date", F.lit(date(2023, 1, 1)))
    gaps = df.withColumn(X[0], F.when(F.col("row_id") % 9 > 0, F.col(X[0])))
    one, many = [make(), make()], [make(), make()]
    trees.grow_windows(one, gaps.coalesce(1), day, [(0, 100), (50, 200)], mirrored=True, tasks=1)
    trees.grow_windows(many, gaps.repartition(5), day, [(0, 100), (50, 200)], mirrored=True, tasks=12)
    for a, b in zip([m for ms in one for m in ms], [m for ms in many for m in ms]):
        assert a.model.keys() == b.model.keys() and all(np.array_equal(a.model[c], b.model[c]) for c in a.model)
    assert not np.array_equal(one[0][0].model["value"], one[1][0].model["value"])
    alone = make()
    trees.grow_windows([alone], gaps.where(day >= 50), F.lit(0), [(0, 1)], mirrored=True)
    assert np.array_equal(alone[1].model["cut"], one[1][1].model["cut"]) and alone[0].model["fill"][0] == 0.0
    assert trees.waves([5, 4, 3, 20, 1], 10) == [range(0, 2), range(2, 3), range(3, 4), range(4, 5)]


def test_walk_forward_and_saving_with_grown_trees(table, spark, tmp_path):
    df, *_ = table
    trees_ = lambda seed: {"boost": trees.Grown(X, "boost", {"trees": 5, "rate": 0.1, "leaves": 5, "least": 20, "l2": 5.0}), "extra": trees.Grown(X, "forest", {"trees": 5, "depth": 3, "least": 18, "share": 0.7, "seed": seed, "bootstrap": False})}
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)} | trees_(seed)
    oof = models.walk_forward(df, 80, 40, 100, 30, make).cache()
    blocks = models.validation_blocks(df, 80, 40, 100, 30)
    assert oof.count() == sum(b[3] for b in blocks) and len(blocks) == 3
    start, end = blocks[1][:2]
    own = trees_(43)
    for m in own.values():
        m.fit(models.augment_symmetric(df.where((F.col("date") >= F.lit(start - timedelta(days=80))) & (F.col("date") < F.lit(start)))))
    alone = models.Ensemble(own, np.array([0.5, 0.5]), models.Calibrator())
    want = {r.row_id: (r.p_boost, r.p_extra) for r in alone.predict(df.where((F.col("date") >= F.lit(start)) & (F.col("date") < F.lit(end)))).collect()}
    got = {r.row_id: (r.p_boost, r.p_extra) for r in oof.where("fold_id = 1").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    alone.save(spark, str(tmp_path / "e"))
    again = {r.row_id: (r.p_boost, r.p_extra) for r in models.Ensemble.load(spark, str(tmp_path / "e")).predict(df).collect()}
    assert all(again[i] == pytest.approx(want[i]) for i in want)


def test_the_five_models_have_the_sizes_of_the_method():
    m = models.candidate_models(1000, 7)
    assert list(m) == ["rating", "logistic", "boost", "extra", "forest"] and all(m[n].columns == FEATURES for n in list(m)[1:])
    assert m["boost"].options == {"trees": 240, "rate": 0.035, "leaves": 15, "least": 45, "l2": 5.0}
    assert [(m[n].options["trees"], m[n].options["depth"], m[n].options["least"], m[n].options["share"], m[n].options["bootstrap"]) for n in ("extra", "forest")] == [(350, 8, 18, 0.65, False), (350, 8, 18, 0.7, True)]


def asked_by(monkeypatch, name, found):
    """What a query asks of an operator, which then gives ``found``."""
    seen = {}
    monkeypatch.setattr(models, name, lambda rows, *a, **o: seen.update(o, columns=rows.columns, args=a) or found)
    return seen


def test_m_horizons_compares_the_whole_method(table, spark, monkeypatch):
    df, *_ = table
    monkeypatch.setattr(sq.mq, "features", lambda s, d, only: df.select(*[F.lit(0.0).alias(c) for c in only]))
    row = dict.fromkeys(("log_loss", "brier", "fold_log_loss_std", "selection_score"), 0.5) | {"horizon_days": 365, "n": 1}
    seen = asked_by(monkeypatch, "compare_horizons", (365, [row]))
    assert sq.m_horizons(spark, "").count() == 1
    assert seen["args"] == ([365, 730],) and {*FEATURES} <= {*seen["columns"]} and seen.keys() == {"args", "columns"}


def test_m_walk_forward_fits_the_whole_method(table, spark, monkeypatch):
    df, *_ = table
    monkeypatch.setattr(mq, "features", lambda s, d, only: df.select(*[F.lit(0.0).alias(c) for c in only]))
    scored = df.select("row_id", "target", *[F.lit(0.5).alias(c) for c in ("fold_id", "p_boost", "ensemble_raw", "predicted_probability", "ensemble_dispersion", "reliability")])
    seen = asked_by(monkeypatch, "walk_forward", scored)
    assert mq.m_walk_forward(spark, "").count() == 600
    assert seen["args"] == (365,) and {*FEATURES} <= {*seen["columns"]} and seen.keys() == {"args", "columns"}


def test_m_final_fits_the_whole_method(table, spark, monkeypatch):
    df, *_ = table
    monkeypatch.setattr(sq.mq, "features", lambda s, d, only: df.select(*[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in only]))
    seen = asked_by(monkeypatch, "walk_forward", df)
    final = models.Ensemble({"rating": models.RatingBaseline()}, np.array([1.0]), models.Calibrator())
    last = []
    monkeypatch.setattr(models, "fit_final", lambda *a, **o: last.append((a[2:], o)) or final)
    assert sq.m_final(spark, "").count() == 540 + 3
    assert seen["args"] == (365,) and {*FEATURES} <= {*seen["columns"]} and seen.keys() == {"args", "columns"}
    assert last == [((365, date(2023, 7, 19) - timedelta(days=180)), {})]


def test_the_final_calibration_is_that_of_the_final_weights(table):
    df, *_ = table
    make = lambda n, seed: {"rating": models.RatingBaseline(), "logistic": models.Logistic(X, 4.5)}
    oof = models.walk_forward(df, 80, 40, 100, 30, make).cache()
    final = models.fit_final(df, oof, 80, date(2023, 7, 19), make)
    names = ["p_rating", "p_logistic"]
    raw = oof.where("date < '2023-07-19'").withColumn("raw", sum(F.lit(float(w)) * F.col(c) for w, c in zip(models.blend_weights(oof.where("date < '2023-07-19'"), names), names)))
    assert final.calibrator.model.beta == pytest.approx(models.Calibrator().fit(raw, "raw").model.beta, abs=1e-9)
    assert final.calibrator.model.beta != pytest.approx(models.Calibrator().fit(raw, "ensemble_raw").model.beta, abs=1e-6)


def test_m_offset_fits_the_whole_method(table, spark, monkeypatch):
    df, *_ = table
    monkeypatch.setattr(sq.mq, "features", lambda s, d, only: df.select(*[F.lit(0.0).alias(c) for c in only]))
    monkeypatch.setattr(sq.mq, "_quotes", lambda s, d: None)
    from rallyframe.operators import linking

    monkeypatch.setattr(linking, "link_exact", lambda oof, quotes: (oof, None))
    monkeypatch.setattr(models, "with_reference_gaps", lambda linked: linked)
    scored = df.select("row_id", *[F.lit(0.5).alias(c) for c in ("fold_id", "market_probability_a", "value_probability")])
    first = asked_by(monkeypatch, "walk_forward", scored)
    second = asked_by(monkeypatch, "walk_forward_offset", scored)
    assert sq.m_offset(spark, "").count() == 600
    assert first["args"] == (365,) and {*FEATURES} <= {*first["columns"]} and first.keys() == {"args", "columns"}
    assert second["args"] == (models.OFFSET_FEATURES, "market_logit_a", "market_probability_a") and second.keys() == {"args", "columns"}
