import numpy as np
import pytest

from rallyframe.llm.pairwise import global_ranks, offence_defence


def brute(rows, smoothing=2.0):
    out = {}
    for g in {r[0] for r in rows if None not in r[:3]}:
        own = [r for r in rows if r[0] == g and None not in r[:3] and r[1] != r[2]]
        ids = sorted({x for r in own for x in r[1:3]})
        w, l = [np.array([ids.index(r[k]) for r in own]) for k in (1, 2)]
        o = d = np.ones(len(ids))
        for _ in range(400):
            o = np.bincount(w, 1 / d[l], len(ids)) + smoothing
            d = np.bincount(l, 1 / o[w], len(ids)) + smoothing
        out |= {(g, x): s for x, s in zip(ids, o / d)}
    return out


def test_equals_a_dense_iteration(spark):
    rng = np.random.default_rng(3)
    rows = [("Hard", f"p{min(a, b)}", f"p{max(a, b)}", "x") if rng.random() < 0.8 else ("Hard", f"p{max(a, b)}", f"p{min(a, b)}", "x") for a, b in rng.integers(0, 12, (300, 2))]
    rows += [("Clay", "p1", "p2", "x"), ("Clay", "p3", "p4", "x"), (None, "p1", "p2", "x"), ("Clay", None, "p2", "x"), ("Clay", "p9", "p9", "x"), ("Clay", "p1", "p2", "x")]
    got = offence_defence(spark.createDataFrame(rows, "s string, w string, l string, strength string"), "s", "w", "l", tolerance=1e-9).collect()
    want = brute(rows)
    assert {(r.s, r["item"]) for r in got} == set(want)
    for r in got:
        assert r.strength == pytest.approx(want[r.s, r["item"]], rel=1e-6)
    assert {(r["item"], r.wins, r.losses) for r in got if r.s == "Clay"} == {("p1", 2, 0), ("p2", 0, 2), ("p3", 1, 0), ("p4", 0, 1)}


def test_split_items_and_items_without_comparisons(spark):
    rng = np.random.default_rng(4)
    rows = [("g", *((f"p{a}", "hot") if rng.random() < 0.4 else ("hot", f"p{a}"))) for a in rng.integers(0, 40, 120)] + [("g", "p1", "p2")]
    given = [(*r, 1) for r in rows] + [("g", "alone", "hot", 0), ("h", "alone", "too", None), (None, "x", "y", 0), ("g", None, "y", 0)]
    df = spark.createDataFrame(given, "s string, w string, l string, played int")
    got = {(r.s, r["item"]): r for r in offence_defence(df, "s", "w", "l", tolerance=1e-9, weight="played", block=7).collect()}
    want = brute(rows) | {("g", "alone"): 1.0, ("h", "alone"): 1.0, ("h", "too"): 1.0}
    assert set(got) == set(want) and all(r.converged for r in got.values())
    for k, r in got.items():
        assert r.strength == pytest.approx(want[k], rel=1e-6)
    assert (got["g", "alone"].wins, got["g", "alone"].losses) == (0, 0)
    assert not any(r.converged for r in offence_defence(df, "s", "w", "l", tolerance=1e-12, iterations=4).collect())


def test_strengths_are_recovered_from_uneven_comparisons(spark):
    rng = np.random.default_rng(8)
    true = rng.normal(0, 1.2, 25)
    rows = []
    for a, b in rng.integers(0, 25, (6000, 2)) ** 2 // 24:
        if a != b:
            w, l = (a, b) if rng.random() < 1 / (1 + np.exp(true[b] - true[a])) else (b, a)
            rows.append(("g", f"{w:02d}", f"{l:02d}"))
    got = {r["item"]: np.log(r.strength) for r in offence_defence(spark.createDataFrame(rows, "g string, w string, l string"), "g", "w", "l").collect()}
    ids = sorted(got)
    assert np.corrcoef([got[i] for i in ids], [true[int(i)] for i in ids])[0, 1] > 0.95


def test_empty_and_ranks(spark):
    assert offence_defence(spark.createDataFrame([], "g string, w string, l string"), "g", "w", "l").count() == 0
    rows = [(g, f"i{k:02d}", float(k // 2)) for g in ("a", "b") for k in range(30)] + [("c", "z", None)]
    got = global_ranks(spark.createDataFrame(rows, "g string, i string, v double").repartition(7), "g", "v", "i").collect()
    for g in "abc":
        own = sorted((r for r in got if r.g == g), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, len(own) + 1))
        assert [r.i for r in own] == [i for _, i, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-(r[2] or 0), r[1]))]
