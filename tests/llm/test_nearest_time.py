import random
from datetime import date, timedelta

import numpy as np
import pytest

from rallyframe.llm.nearest_time import MOST_ERROR, LearnedIndex, nearest_in_time

Q, R = "qid long, a string, b string, day date, rid string", "rid long, a string, b string, day date, qid string"


def brute(qs, rs, tol):
    out = []
    for i, a, b, d, _ in qs:
        own = [(abs((e - d).days), e, r) for r, x, y, e, _ in rs if None not in (a, b, d, x, y, e) and (x, y) == (a, b) and abs((e - d).days) <= tol]
        if own:
            out.append((i, min(own)[2]))
    return sorted(out)


@pytest.mark.parametrize("tol", [0, 8, 40])
def test_matches_brute_force_across_shards_with_ties_and_a_hot_entity(spark, tol):
    rng = random.Random(tol)
    day = lambda: None if rng.random() < 0.04 else date(2021, 12, 1) + timedelta(days=rng.randrange(120))
    who = lambda: rng.choice([("h", "h")] * 4 + [("a", "b"), ("ab", ""), ("a", None), ("é", "x")])
    qs = [(i, *who(), day(), "") for i in range(300)] + [(0, "h", "h", date(2022, 1, 1), "")]
    rs = [(1000 - i, *who(), day(), "") for i in range(250)]
    got = nearest_in_time(spark.createDataFrame(qs, Q), spark.createDataFrame(rs, R), "qid", "rid", ["a", "b"], "day", "day", tol, rows_per_bucket=60)
    assert sorted(map(tuple, got.collect())) == brute(qs, rs, tol)


def test_empty_tables(spark):
    q, r = spark.createDataFrame([(1, "a", "b", date(2022, 1, 1), "")], Q), spark.createDataFrame([], R)
    assert nearest_in_time(q, r, "qid", "rid", ["a", "b"], "day", "day", 8).count() == 0
    assert nearest_in_time(q.limit(0), r, "qid", "rid", ["a", "b"], "day", "day", 8).count() == 0


def test_learned_index_equals_binary_search():
    rng = np.random.default_rng(1)
    for n in (1, 5, 128, 129, 3000):
        for kinds in (1, 7):
            shard = np.sort(rng.integers(0, kinds, n))
            keys = np.sort(np.unique(rng.integers(0, rng.choice([3, 500, 10**6]), n)) ** 2)
            shard = np.sort(rng.integers(0, kinds, len(keys)))
            keys = keys + shard * 10**13
            x = np.concatenate([keys, keys + 1, keys - 1, rng.integers(-5, keys.max() + 5, 200)])
            index = LearnedIndex(keys, shard)
            assert (index.first_at_least(x) == np.searchsorted(keys, x)).all()
            piece = np.repeat(np.arange(len(index.start)), index.end - index.start + 1)
            assert np.abs(index._guess(piece, keys) - np.arange(len(keys))).max() <= MOST_ERROR and all(shard[a] == shard[b] for a, b in zip(index.start, index.end))
