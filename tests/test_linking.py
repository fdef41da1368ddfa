from datetime import date, timedelta
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rallyframe.functions.blocks import Texts
from rallyframe.functions.similarity import event_ratio, short_name_similarity
from rallyframe.operators import candidates, linking

D = date(2024, 3, 4)
ROWS = [(1, D, "Ana Silva Costa", "Bo Berg", "Lyon Challenger"), (2, D, "Cy Dahl", "Eve Falk", "Oslo"), (3, D, "Gil Hart", "Ida Jung", "Rome"), (4, None, "Ana Silva Costa", "Bo Berg", "Lyon"), (5, D, None, "Zed Quux", None)]
QUOTES = [
    (10, D + timedelta(2), "Bo Berg", "Ana Silva Costa", 1.5, 2.5, "Lyon", "s"), (11, D + timedelta(2), "Ana Silva Costa", "Bo Berg", 2.4, 1.6, "Lyon Challenger", "s"),
    (12, D + timedelta(30), "Cy Dahl", "Eve Falk", 1.8, 2.0, None, "s"), (13, D, "Hart G.", "Jung I.", 1.7, 2.1, "Rome", None), (14, D, "Silva Costa A.", "Berg B.", 1.9, 1.9, "Lyon", "s"), (15, D, "Cy Dahl", "Eve Falk", 1.0, None, "Oslo", "s"),
]


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame(ROWS, "row_id long, date date, player_a string, player_b string, tourney_name string")
    q = spark.createDataFrame(QUOTES, "odds_id long, date date, player1 string, player2 string, odd1 double, odd2 double, tournament string, source string")
    return f, q


def test_exact_pairs_take_the_nearest_day_then_the_closer_event(tables):
    matched, audit = linking.link_exact(*tables, day="date")
    got = {r.row_id: (r.status, r.odds_id, r.gap, r.swapped) for r in audit.collect()}
    assert got[1] == ("matched", 11, 2, False) and got[2][0] == "date_gap" and got[3][0] == "no_pair" and got[4][0] == "date_gap" and got[5][0] == "no_pair"
    row = matched.collect()[0]
    assert (row.row_id, row.odd_a, row.odd_b) == (1, 2.4, 1.6) and row.market_probability_a == pytest.approx(1.6 / 4.0)


def test_signatures_meet_short_names(tables):
    _, audit = linking.link_signatures(*tables, day="date")
    got = {r.row_id: (r.status, r.odds_id, r.reuse) for r in audit.collect()}
    assert got[1] == ("matched", 14, 1) and got[3] == ("matched", 13, 1) and got[5][0] == "no_pair" and got[4][0] == "date_or_orientation_fail"


@pytest.mark.parametrize("weights", [linking.NARROW, linking.WIDE])
def test_anchors_choose_by_weighted_similarity(tables, weights):
    _, audit = linking.link_anchors(*tables, weights=weights)
    got = {r.row_id: r for r in audit.collect()}
    scores = []
    for q in QUOTES:
        if q[0] in (10, 11, 14):
            sim = lambda a, b: short_name_similarity(a, b, weights.initials)
            pair = max(0.5 * (sim("Ana Silva Costa", q[2]) + sim("Bo Berg", q[3])), 0.5 * (sim("Ana Silva Costa", q[3]) + sim("Bo Berg", q[2])))
            scores.append((weights.pair * pair + weights.event * event_ratio("Lyon Challenger", q[6], " challenger") + weights.date * (1 - abs((q[1] - D).days) / 9), q[0]))
    scores.sort(reverse=True)
    assert got[1].total == pytest.approx(scores[0][0]) and got[1].margin == pytest.approx(scores[0][0] - scores[1][0])
    assert got[1].status == "ambiguous" and got[3].status == "matched" and got[3].tier == "pair_anchor"
    assert got[4].status == got[5].status == "no_candidate"


def test_empty_sides(tables):
    f, q = tables
    assert {r.status for r in linking.link_exact(f, q.limit(0), day="date")[1].collect()} == {"no_pair"}
    assert linking.link_anchors(f.limit(0), q)[1].count() == 0


def test_rows_meet_quotes_of_a_similar_event_without_a_shared_word(spark):
    f = spark.createDataFrame([(1, D, "Ana Silva", "Bo Berg", "Ulm"), (2, D, "Ana Silva", "Bo Berg", None)], "row_id long, date date, player_a string, player_b string, tourney_name string")
    q = spark.createDataFrame([(7, D, "Silvq A.", "Borg B.", 1.5, 2.5, "Ulm Cup", "s"), (8, D, "Silvq A.", "Borg B.", 1.5, 2.5, "Zagreb", "s")], "odds_id long, date date, player1 string, player2 string, odd1 double, odd2 double, tournament string, source string")
    got = {r.row_id: r for r in linking.link_anchors(f, q, weights=linking.WIDE)[1].collect()}
    assert (got[1].odds_id, got[1].tier, got[1].candidates) == (7, "date_fallback", 1) and got[2].status == "no_candidate"


@pytest.mark.parametrize(("full", "short", "expected"), [("Ana Silva Costa", "Silva A.", 1.0), ("Ana Silva Costa", "Silva C. A.", 0.84 + 0.16 / 2), ("Ana Silva", "ana SILVA", 1.0), ("Ana Silva", "Li", 0.84 * 2 / 7), ("", "x", 0.0), (None, None, 0.0)])
def test_short_names(full, short, expected):
    assert short_name_similarity(full, short) == pytest.approx(expected, abs=0.02)


def test_sides_hold_no_more_than_links_compare(tables):
    f, q = linking._sides(*tables, "date", "row_id", "odds_id")
    assert f.columns == ["f", "fday", "fevent", "na", "nb"] and q.columns == ["q", "qday", "qevent", "n1", "n2"]
    assert {r.f for r in f.collect()} == {1, 2, 3, 4, 5} and {r.q for r in q.collect()} == {10, 11, 12, 13, 14}


def test_plain_signatures_audit_each_row_once_from_a_staged_table(tables):
    f, q = tables
    twice = f.where("row_id = 1").withColumns({"player_b": F.col("player_a")})  # both sides have the same signatures
    _, audit = linking.link_signatures(twice, q.where("odds_id = 14").withColumn("player2", F.col("player1")), day="date", events="equal")
    assert audit.inputFiles() and [(r.status, r.odds_id, r.gap, r.reuse, r.swapped) for r in audit.collect()] == [("matched", 14, 0, 1, False)]


@pytest.mark.parametrize("weights", [linking.NARROW, linking.WIDE])
def test_anchors_equal_a_plain_loop_and_store_no_candidates(spark, monkeypatch, weights):
    word = lambda i, n: ["Berg", "Borg", "Bergson", "Silva", "Silvan", "Costa", "Kost", "Lund", "Lunden", "Marq"][(i * n + i // 3) % 10]
    rows = [(i, D + timedelta(i % 11), f"Ana {word(i, 3)} Dahl", f"{word(i, 7)} Eve {word(i + 1, 3)}", ["Lyon Challenger", "Oslo", None][i % 3]) for i in range(60)]
    quotes = [(i, D + timedelta(i % 19 - 4), ["Dahl A.", "Dahl Ana", f"{word(i, 3)} A."][i % 3], [f"{word(i, 7)} E.", f"Eve {word(i, 9)}"][i % 2], 1.5, 2.5, ["Lyon", "Lion Cup", "Osla", ""][i % 4], "s") for i in range(150)]
    f = spark.createDataFrame(rows, "row_id long, date date, player_a string, player_b string, tourney_name string")
    q = spark.createDataFrame(quotes, "odds_id long, date date, player1 string, player2 string, odd1 double, odd2 double, tournament string, source string")
    stored, keep = [], linking.stage_table
    monkeypatch.setattr(linking, "stage_table", lambda df: stored.append(keep(df)) or stored[-1])
    monkeypatch.setattr(linking, "stage", lambda df: stored.append(keep(df)) or stored[-1])
    got = {r.row_id: r for r in linking.link_anchors(f, q, weights=weights)[1].collect()}
    last, surname = lambda x: x.lower().split()[-1], lambda x: [w for w in x.lower().replace(".", "").split() if len(w) > 2][-1]
    met = 0
    for i, d, a, b, e in rows:
        near = [x for x in quotes if abs((x[1] - d).days) <= 8]
        own = {last(a), last(b)}
        pair = [x for x in near if sorted((last(a), last(b))) == sorted((surname(x[2]), surname(x[3])))]
        one = [x for x in near if own & {surname(x[2]), surname(x[3])}]
        by_date = [x for x in near if event_ratio(e, x[6], " challenger") >= 0.45] if weights.by_date else []
        tier, found = next(((t, c) for t, c in (("pair_anchor", pair), ("single_anchor", one), ("date_fallback", by_date)) if c), (None, []))
        sim = lambda x, y: short_name_similarity(x, y, weights.initials)
        scored = []
        for x in found:
            direct, turned = 0.5 * (sim(a, x[2]) + sim(b, x[3])), 0.5 * (sim(a, x[3]) + sim(b, x[2]))
            ev, gap = event_ratio(e, x[6], " challenger"), abs((x[1] - d).days)
            scored.append((-(weights.pair * max(direct, turned) + weights.event * ev + weights.date * max(0.0, 1.0 - gap / 9.0)), -max(direct, turned), -ev, gap, x[0], turned > direct))
        scored.sort()
        met += len(scored)
        r = got[i]
        assert (r.tier, r.candidates) == (tier, len(found) or None)
        if scored:
            assert (-r.total, -r.pair_score, -r.event_similarity, r.gap, r.odds_id, r.swapped) == scored[0]
            assert r.margin == (scored[1][0] - scored[0][0] if len(scored) > 1 else 1.0)
    assert met > 400 and max(x.count() for x in stored) <= 150


def test_ratios_of_many_pairs_equal_difflib():
    words = ["", "a", "abab", "baba", "abcabcab", "cabcab", "xyz 12", "12 zyx", "lyon open", "open lyon", "ab" * 110, "ba" * 99, "aaaa", "aabaa"]
    texts = Texts()
    at = np.array([texts.add(w) for w in words])
    texts.close()
    a, b = [x.ravel() for x in np.meshgrid(at, at)]
    assert texts.ratios(a, b).tolist() == [SequenceMatcher(None, words[x], words[y]).ratio() for x, y in zip(a, b)]
    assert (texts.bounds(a, b) >= texts.ratios(a, b) - (a == b)).all()


@pytest.mark.parametrize(("limit", "value"), [("_EVENTS", 0), ("_MET", 7)])
def test_a_bucket_has_the_same_best_however_it_is_cut(monkeypatch, limit, value):
    rows, quotes, words = 30, 90, ["Lyon", "Lion Cup", "Oslo", "Osla Open", "", None]
    left = pa.table({"f": range(rows), "k": [""] * rows, "d": [i % 5 for i in range(rows)], "p": [0] * rows, "fevent": [words[i % 6] for i in range(rows)], "na": [f"ana {'berg' * (i % 3 + 1)}" for i in range(rows)], "nb": [f"bo {'kost' * (i % 2 + 1)}" for i in range(rows)]})
    right = pa.table({"q": range(quotes), "k": [""] * quotes, "d": [i % 12 for i in range(quotes)], "p": [0] * quotes, "qevent": [words[i % 6] for i in range(quotes)], "n1": [f"{'borg' * (i % 3 + 1)} a" for i in range(quotes)], "n2": [f"{'kast' * (i % 4)} b" for i in range(quotes)]})

    def best() -> dict:
        lines = sorted(candidates._meet(left, right, 3, linking.WIDE, 0.45).to_pylist(), key=lambda x: (x["f"], -x["total"], -x["pair_score"], -x["event_similarity"], x["gap"], x["q"]))
        return {f: (sum(x["met"] for x in lines if x["f"] == f), [x["q"] for x in lines if x["f"] == f][:2]) for f in range(rows)}

    whole = best()
    monkeypatch.setattr(candidates, limit, value)
    assert best() == whole and whole[0][0] == sum(event_ratio("Lyon", words[i % 6], " challenger") >= 0.45 and i % 12 <= 3 for i in range(quotes))
