from statistics import median

import pytest
from pyspark.sql import functions as F

from rallyframe.operators.skew import hot_keys, lookup_join, skew_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_same_rows_as_a_plain_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else (None if i % 2 else f"k{i % 5}")) for i in range(300)], "i long, k string")
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), (None, 4), ("other", 5), ("hot", 6)], "k string, v int")
    assert hot_keys(left, ["k"], 10) == {("hot",): 6}
    want = sorted(map(tuple, left.join(right, "k", how).select("i", "k", "v").collect()), key=str)
    assert sorted(map(tuple, skew_join(left, right, ["k"], how, 10).select("i", "k", "v").collect()), key=str) == want
    assert sorted(map(tuple, lookup_join(left, right, ["k"], how).select("i", "k", "v").collect()), key=str) == want


def test_null_keys_are_never_hot_and_empty_tables_have_none(spark):
    df = spark.createDataFrame([(None,)] * 50 + [("a",)], "k string")
    assert hot_keys(df, ["k"], 2) == {}
    assert hot_keys(df.limit(0), ["k"], 1) == {}


def test_no_task_holds_a_hot_key(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = spark.range(60_000).select("id", F.when(F.col("id") % 10 == 0, F.lit(-1)).when(F.col("id") % 10 < 4, F.lit(-2)).otherwise(F.col("id") % 5000).alias("k"))
        right = spark.range(-2, 5000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        sizes = [r[1] for r in skew_join(left, right, ["k"], at_least=100).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 60_000 and max(sizes) <= 3 * median(sizes)
