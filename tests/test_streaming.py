from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from rallyframe.operators.ratings import pre_match_ratings, ratings_and_states
from rallyframe.streaming.rolling import activity, first_seen, rate_batches


def test_windows_drop_late_rows_and_equal_the_batch_form(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", t + timedelta(days=i), 1.0) for i in range(10)] + [("a", t + timedelta(days=1), 1.0)]
    src = str(tmp_path / "in")
    schema = "k string, ts timestamp, v double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = activity(stream, "ts", "k", "v").writeStream.outputMode("append").format("memory").queryName("act").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.start, r.end): (r.n, r.total) for r in activity(spark.read.parquet(src), "ts", "k", "v").collect()}
    got = {(r.start, r.end): (r.n, r.total) for r in spark.sql("select * from act").collect()}
    assert got and all(want[k] == v for k, v in got.items())
    q = first_seen(stream, "ts", ["k", "ts"]).writeStream.outputMode("append").format("memory").queryName("seen").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from seen").first()[0] == 10


def test_rated_batches_equal_one_fold_and_reruns_change_nothing(spark, tmp_path):
    rows = [(i, date(2024, 1, 1) + timedelta(days=i // 2), f"t{i % 2}", 6, 0.0, *(("a", "b") if i % 3 else ("c", "a")), "Hard", 10.0, None, i % 5 != 0) for i in range(20)]
    df = spark.createDataFrame(rows, "row_id long, proxy_date date, tourney_id string, round_order int, match_num double, winner_key string, loser_key string, surface string, winner_rank double, loser_rank double, is_clean boolean")
    out = {}
    step = rate_batches(str(tmp_path / "state"), lambda d, b: out.update({r.row_id: tuple(r) for r in d.collect()}))
    for n, (lo, hi) in enumerate([(0, 8), (8, 14), (14, 20)]):
        part = df.where((F.col("row_id") >= lo) & (F.col("row_id") < hi))
        step(part, n)
        step(part.union(part), n)
    want = {r.row_id: tuple(r) for r in pre_match_ratings(df).collect()}
    assert out == want


def test_a_day_spread_over_batches_is_rated_from_the_days_before(spark, tmp_path):
    rows = [(i, date(2024, 1, 1) + timedelta(days=i // 6), f"t{i % 2}", 6, float(i), *((f"p{i % 4}", f"p{(i + 1 + i // 4 % 2) % 4}")), "Clay" if i % 3 else "Hard", 10.0 + i, None, i % 7 != 0) for i in range(40)]
    rows = [r for r in rows if r[5] != r[6]]
    df = spark.createDataFrame(rows, "row_id long, proxy_date date, tourney_id string, round_order int, match_num double, winner_key string, loser_key string, surface string, winner_rank double, loser_rank double, is_clean boolean")
    out = {}
    step = rate_batches(str(tmp_path / "state"), lambda d, b: out.update({r.row_id: tuple(r) for r in d.collect()}))
    for n, lo in enumerate(range(0, 40, 9)):
        step(df.where((F.col("row_id") >= lo) & (F.col("row_id") < lo + 9)), n)
    step(df.limit(0), 9)
    assert out == {r.row_id: tuple(r) for r in pre_match_ratings(df).collect()}


def test_states_are_saved_and_taken_up_again(spark, tmp_path):
    rows = [(i, u, date(2024, 1, 1) + timedelta(days=i), "t", 6, 0.0, *((f"{u}a", f"{u}b") if i % 3 else (f"{u}c", f"{u}a")), "Hard", None, 40.0, True) for i in range(12) for u in ("x", "y")]
    rows = [(k, *r[1:]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "row_id long, u string, proxy_date date, tourney_id string, round_order int, match_num double, winner_key string, loser_key string, surface string, winner_rank double, loser_rank double, is_clean boolean")
    whole = {r.row_id: tuple(r) for r in pre_match_ratings(df, universe="u").collect()}
    old = df.where("row_id < 14")
    ratings, states = ratings_and_states(old, universe="u")
    assert {r.row_id: tuple(r) for r in ratings.collect()} == {k: v for k, v in whole.items() if k < 14}
    states.write.parquet(str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.groupBy("universe").count().count() == 2
    again = df.where(F.unix_date("proxy_date") >= F.lit(back.agg(F.min("day")).first()[0]))
    assert {r.row_id: tuple(r) for r in pre_match_ratings(again, universe="u", states=back).collect()} == {k: v for k, v in whole.items() if k >= 12}
    assert [x.count() for x in ratings_and_states(df.limit(0))] == [0, 0]
