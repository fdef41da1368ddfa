from datetime import date, timedelta

from rallyframe.operators.rolling import rolling_totals

SCHEMA = "player string, day date, minutes double, sum_7d string"


def brute(rows, periods=(7, 30)):
    rows = [(p, d, v) for p, d, v, _ in rows if p is not None and d is not None]
    out = {}
    for p in {r[0] for r in rows}:
        own = [(d, v) for q, d, v in rows if q == p]
        day, last = min(d for d, _ in own), max(d for d, _ in own)
        while day <= last:
            sums = [sum(v for d, v in own if v is not None and v == v and day - timedelta(days=n) < d <= day) for n in periods]
            out[p, day] = (*sums, *[s / n for s, n in zip(sums, periods)])
            day += timedelta(days=1)
    return out


def test_matches_brute_force_with_nulls_ties_and_a_clashing_column(spark):
    d = date(2020, 1, 1)
    rows = [("a", d, 90.0, "x"), ("a", d, 30.0, "x"), ("a", d + timedelta(days=6), None, ""), ("a", d + timedelta(days=7), float("nan"), ""), ("a", d + timedelta(days=45), 10.0, None)]
    rows += [("b", d, None, None), (None, d, 5.0, None), ("c", None, 5.0, None), ("d", d + timedelta(days=3), float("inf"), "y"), ("a", d, 90.0, "x")]
    got = rolling_totals(spark.createDataFrame(rows, SCHEMA), "player", "day", "minutes").collect()
    rows = [(p, x, None if v == float("inf") else v, y) for p, x, v, y in rows]
    assert {(r[0], r[1]): tuple(r)[2:] for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_empty_table_has_the_columns(spark):
    df = rolling_totals(spark.createDataFrame([], SCHEMA), "player", "day", "minutes", (3,))
    assert df.columns == ["player", "day", "sum_3d", "mean_3d"] and df.count() == 0
