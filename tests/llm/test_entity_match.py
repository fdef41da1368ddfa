import itertools
import random
from datetime import date, timedelta

import pyarrow as pa
import pytest

from rallyframe.llm import entity_match as m

SCHEMA = "id long, k1 string, k2 string, day date, event string, surface string"
D = date(2023, 5, 1)


def test_assignment_is_the_best_of_all():
    rng = random.Random(6)
    for _ in range(60):
        r, c = rng.randint(1, 4), rng.randint(1, 4)
        g = [[rng.choice([0.0, rng.random()]) for _ in range(c)] for _ in range(r)]
        pairs = m.Assignment(g).solve()
        assert len(set(pairs.values())) == len(pairs)
        cols = [*range(c), *[None] * r]
        best = max(sum(g[i][j] for i, j in enumerate(p) if j is not None) for p in itertools.permutations(cols, r))
        assert sum(g[i][j] for i, j in pairs.items()) == pytest.approx(best)


def test_event_similarity():
    assert m.event_similarity("ATP Lake Jaskora Open", "Lake Jaskora Open") == 1.0 and m.event_similarity("Lorne. Cup", "Lornellow Challenger Cup") > 0.85
    assert m.event_similarity("Otstellow", "Orstellow Challenger Cup") > 0.8 and m.event_similarity("Fissidor Classic", "Bad Yrbarra II") < 0.5
    assert m.event_similarity(None, "x") is None and m.event_similarity("ATP", "x") is None


def key(player, name):
    """The name key of a linked player, of a typed name, or of neither."""
    return m.name_key(name or player, player) if player else m.name_key(name) if name else None


def rows(spark, given):
    return spark.createDataFrame([(i, key(p1, n1), key(p2, n2), *rest) for i, p1, p2, n1, n2, *rest in given], SCHEMA)


def test_name_keys():
    assert m.name_key("Leandrik von Kujofegor", "7") == "kujofegor leandrik#7" and m.name_key(" L. KUJOFEGOR jr") == "kujofegor l" and m.name_key("...") == m.name_key(None) == ""


def tables(spark):
    right = [(1, "a", "b", None, None, D, "Lyon Open", "H"), (2, "b", "a", None, None, D + timedelta(7), "Oslo Classic", "C"), (3, "a", "c", None, None, D, "Lyon Open", "H"), (4, None, "d", "Maria Lopez", "Dee", D, "Lyon Open", "H"), (5, "e", "f", None, None, None, "Lyon Open", "H"), (6, "a", "b", None, None, D + timedelta(400), "Lyon Open", "H")]
    left = [
        (10, "b", "a", None, None, D + timedelta(2), "LYON", "H"), (11, "a", "b", None, None, D + timedelta(6), "Oslo Clasic", None), (12, "a", "b", None, None, D + timedelta(60), "Lyon Open", "H"), (13, "a", "z", None, None, D, "Lyon Open", "H"), (14, "d", None, "Dee", "Marla Lopez", D + timedelta(1), "Lyon Opn", "H"),
        (15, "a", "b", None, None, None, "Lyon Open", "H"), (16, None, None, "x", "y", D, "Lyon Open", "H"), (17, "c", "a", None, None, D + timedelta(3), None, None), (18, "a", "b", None, None, D + timedelta(2), "Rome Trophy", "G"), (10, "b", "a", None, None, D + timedelta(2), "LYON", "H"), (19, "b", "a", None, None, D + timedelta(2), "LYON", "H"),
    ]
    return rows(spark, left), rows(spark, right)


def test_quotes_find_their_results(spark):
    left, right = tables(spark)
    got = {r.l: r.r for r in m.match_quotes(left, right).collect()}
    assert got == {10: 1, 11: 2, 14: 4, 17: 3, 19: 1}


def test_neighbours_across_partitions_are_found(spark):
    rng = random.Random(2)
    right = [(i, f"p{i % 40:02d}", f"q{i % 40:02d}", None, None, D + timedelta(days=20 * (i // 40)), "Lyon Open", "H") for i in range(400)]
    left = [(1000 + i, r[2], r[1], None, None, r[5] + timedelta(days=rng.randrange(0, 6)), "Lyon Open", "H") for i, r in enumerate(right)]
    got = {(r.l, r.r) for r in m.match_events(rows(spark, left).repartition(5), rows(spark, right)).collect()}
    assert got == {(1000 + i, i) for i in range(400)}


def test_unlinked_opponents_of_a_hot_player_are_found(spark):
    rng = random.Random(8)
    name = lambda i: " ".join("".join(rng.choice("abcdefghijklmnoprstuvz") for _ in range(9)) for _ in range(2))
    people = [(f"k{i}", name(i)) for i in range(90)]
    # 30 results a week; of every third the opponent is not linked either.
    right = [(i, "hot", None if i % 3 == 0 else k, None, n if i % 3 == 0 else None, D + timedelta(7 * (i // 30)), f"{'LOV'[i // 30]}yon Open", "H") for i, (k, n) in enumerate(people)]
    left = [(1000 + i, None, "hot", n.replace(n[3], "q", 1), None, right[i][5] + timedelta(i % 9), "Zz" + right[i][6], "H") for i, (_, n) in enumerate(people)]
    # A linked opponent whose result has only a name.
    left += [(2000 + i, "hot", people[i][0], None, None, right[i][5] + timedelta(2), right[i][6], "H") for i in range(0, 90, 3)]
    names = dict(people)
    named = lambda r: (*r[:3], *[names.get(p, n) for p, n in zip(r[1:3], r[3:5])], *r[5:])
    got = {(r.l, r.r) for r in m.match_quotes(rows(spark, map(named, left)), rows(spark, map(named, right))).collect()}
    assert got == {(1000 + i, i) for i in range(90)} | {(2000 + i, i) for i in range(0, 90, 3)}


def test_rows_without_any_linked_player_are_found(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abdefghijklmnoprstuvz") for _ in range(9))
    names = [(f"{word()} {word()}", f"{word()} {word()}") for _ in range(60)]
    right = [(i, None if i % 2 else f"x{i}", None if i % 2 else f"y{i}", a, b, D + timedelta(i % 3), f"{'LOV'[i % 3]}yon Open", "H") for i, (a, b) in enumerate(names)]
    left = [(1000 + i, None, None, b, a.replace(a[4], "q", 1), r[5] + timedelta(2), r[6], "H") for i, (r, (a, b)) in enumerate(zip(right, names))]
    left += [(3000, None, None, "nobody here", "no one there", D, "Lyon Open", "H")]
    assert {(r.l, r.r) for r in m.match_quotes(rows(spark, left), rows(spark, right)).collect()} == {(1000 + i, i) for i in range(60)}


@pytest.mark.parametrize("held", [16, 40, 10_000])
def test_windows_carry_their_edges(held):
    rng = random.Random(held)
    sides = [int(rng.random() < 0.6) for _ in range(600)]
    rows = [(s, i, f"p{i // 9}#1", "q#2", 10, None, None, i) for i, s in enumerate(sides)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(m._FIELDS, r)) for r in rows[k : k + 7]], schema=m._SCHEMA) for k in range(0, 600, 7)]
    got = {(r["l"], r["r"]) for b in m._windows(3, held)(iter(batches)) for r in b.to_pylist()}
    right = [i for i, s in enumerate(sides) if s]
    want = set()
    for i, s in enumerate(sides):
        if not s:
            at = sum(j < i for j in right)
            want |= {(i, j) for j in right[max(at - 3, 0) : at + 3] if j // 9 == i // 9}
    assert got == want


def test_empty_tables(spark):
    left, right = tables(spark)
    assert m.match_quotes(left.limit(0), right).count() == 0 and m.match_quotes(left, right.limit(0)).count() == 0
