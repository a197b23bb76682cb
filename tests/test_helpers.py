"""Bucketed windows and pointer doubling against brute force."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parkops.plans.ordering import global_row_number
from parkops.plans.windows import carry_value, prefix_sum


def test_bucketed_windows_equal_plain_windows(spark):
    rnd = random.Random(7)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        key = 0 if rnd.random() < 0.4 else rnd.randint(1, 5)   # one hot key
        rows.append((i, key, t0 + timedelta(minutes=rnd.randint(0, 3000)),
                     rnd.choice([None, rnd.randint(0, 9)]), rnd.randint(1, 5)))
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long, w long") \
        .withColumn("b", F.date_trunc("hour", "ts"))
    got = carry_value(df, ["k"], "b", ["ts", "id"], "v", "pv", "prev")
    got = carry_value(got, ["k"], "b", ["ts", "id"], "v", "nv", "next")
    got = prefix_sum(got, ["k"], "b", ["ts", "id"], "w", "ps")
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = (df.withColumn("pv", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("nv", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
             .withColumn("ps", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["id", "pv", "nv", "ps"]
    assert sorted(got.select(*cols).collect()) == sorted(ref.select(*cols).collect())


def test_global_row_number_is_dense(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"))
    r = global_row_number(df, ["x"], "rn", partitions=5).collect()
    assert sorted((row["x"], row["rn"]) for row in r) == [(i, i + 1) for i in range(1000)]


def test_hot_hour_is_split_by_second(spark):
    from parkops.plans.windows import adaptive_bucket
    rnd = random.Random(17)
    t0 = datetime(2024, 1, 1, 5)
    rows = [(i, 1, t0 + timedelta(seconds=rnd.randint(0, 3599)), rnd.choice([None, i])) for i in range(300)]
    rows += [(1000 + i, 2, t0 + timedelta(hours=rnd.randint(0, 30)), i) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long")
    b, buckets = adaptive_bucket(df, ["k"], "ts", hot_rows=100)
    assert buckets == ("_h", "_b")
    assert b.filter("k = 1").select("_b").distinct().count() > 100   # the hot hour is split
    got = carry_value(b, ["k"], buckets, ["ts", "id"], "v", "pv", "prev")
    got = carry_value(got, ["k"], buckets, ["ts", "id"], "v", "nv", "next")
    got = prefix_sum(got, ["k"], buckets, ["ts", "id"], "id", "ps")
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = (df.withColumn("pv", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("nv", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
             .withColumn("ps", F.sum("id").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["id", "pv", "nv", "ps"]
    assert sorted(got.select(*cols).collect()) == sorted(ref.select(*cols).collect())


def test_global_row_number_on_a_larger_cross_join(spark):
    # several range partitions over a computed input: numbering must stay dense
    zones = spark.range(0, 900).select(F.col("id").alias("z"))
    slots = spark.range(1, 13).select(F.col("id").alias("n"))
    g = zones.crossJoin(F.broadcast(slots))
    r = global_row_number(g, ["z", "n"], "rn", partitions=8)
    bad = r.filter(F.col("rn") != F.col("z") * 12 + F.col("n"))
    assert bad.count() == 0 and r.count() == 900 * 12


def test_without_a_hot_hour_the_plan_is_the_same(spark):
    from parkops.plans.windows import adaptive_bucket
    df = spark.createDataFrame([(i, 1, datetime(2024, 1, 1) + timedelta(minutes=7 * i)) for i in range(50)],
                               "id long, k long, ts timestamp_ntz")
    b, buckets = adaptive_bucket(df, ["k"], "ts", hot_rows=1000)
    assert buckets == ("_h", "_b") and b.filter("_b <> _h").count() == 0


@pytest.mark.parametrize("levels", [("minute",), ("day",), ("day", "minute"), ("hour", "second")])
def test_ordered_lookups_any_bucket_levels(spark, levels):
    from parkops.plans.windows import ordered_lookups
    rnd = random.Random(len("".join(levels)))
    t0 = datetime(2024, 1, 1)
    rows = [(i, rnd.choice([0, 0, 0, 1, 2]), t0 + timedelta(seconds=rnd.randint(0, 3 * 86400)),
             rnd.choice([None, i % 7]), rnd.randint(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, ts timestamp_ntz, v long, w long")
    names = []
    for j, unit in enumerate(levels):
        df = df.withColumn(f"_l{j}", F.date_trunc(unit, "ts"))
        names.append(f"_l{j}")
    got = ordered_lookups(df, ["k"], tuple(names) if len(names) > 1 else names[0], ["ts", "id"],
                          [("prev", "v", "pv"), ("next", "v", "nv"), ("cumsum", "w", "ps")])
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = (df.withColumn("pv", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
             .withColumn("nv", F.first("v", True).over(w.rowsBetween(1, Window.unboundedFollowing)))
             .withColumn("ps", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    cols = ["id", "pv", "nv", "ps"]
    assert sorted(got.select(*cols).collect()) == sorted(ref.select(*cols).collect())
