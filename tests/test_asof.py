import random
from datetime import date, timedelta

import pytest

from rallyframe.operators.asof import known_at

EVENTS = "row_id long, winner_id string, day date, bio_id string"
BIOS = "bio_id long, player_id string, valid_from date, known_on date, row_id string"


def brute(events, bios):
    out = set()
    for e, k, t, _ in events:
        own = [(f, o, i) for i, p, f, o, _ in bios if None not in (p, f, o, i) and p == k and t is not None and f <= t and o <= t]
        if k is not None and own:
            out.add((e, max(own)[2]))
    return out


def run(spark, events, bios, **kw):
    ev, bi = spark.createDataFrame(events, EVENTS), spark.createDataFrame(bios, BIOS)
    return known_at(ev, bi, "row_id", "winner_id", "day", "player_id", "valid_from", "known_on", "bio_id", **kw)


@pytest.mark.parametrize("bucket", [200_000, 40])
def test_matches_brute_force_with_a_hot_key(spark, bucket):
    rng = random.Random(bucket)
    day = lambda: None if rng.random() < 0.05 else date(2020, 1, 1) + timedelta(days=rng.randrange(60))
    who = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None, "none"])
    bios = [(i, rng.choice(["hot", "a", "b", None]), day(), day(), "z") for i in range(80)]
    events = [(i, who(), day(), "z") for i in range(400)]
    got = [tuple(r) for r in run(spark, events, bios, rows_per_bucket=bucket).collect()]
    assert set(got) == brute(events, bios) and len(got) == len(set(got))


def test_later_knowledge_is_never_used(spark):
    d = date(2020, 1, 10)
    bios = [(1, "a", d - timedelta(days=9), d - timedelta(days=9), ""), (2, "a", d - timedelta(days=5), d + timedelta(days=1), ""), (3, "a", d + timedelta(days=1), d - timedelta(days=8), "")]
    assert [tuple(r) for r in run(spark, [(7, "a", d, "")], bios).collect()] == [(7, 1)]


def test_ties_and_repeated_events(spark):
    d = date(2020, 1, 10)
    bios = [(2, "a", d, d, ""), (5, "a", d, d, ""), (5, "a", d, d, ""), (9, "a", d - timedelta(days=1), d, "")]
    assert [tuple(r) for r in run(spark, [(1, "a", d, ""), (1, "a", d, "")], bios).collect()] == [(1, 5), (1, 5)]


def test_empty_tables(spark):
    d = date(2020, 1, 10)
    assert run(spark, [], [(1, "a", d, d, "")]).count() == 0
    assert run(spark, [(1, "a", d, "")], []).count() == 0
