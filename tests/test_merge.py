import random

import pytest
from pyspark.sql import functions as F

from ridelake.operators import merge
from ridelake.sources import tables

SCHEMA = "k string, seq int, v double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("k", "seq", "v").collect())


def random_rows(seed, n, keys):
    random.seed(seed)
    return [(f"k{random.choice(keys)}", i, float(random.randint(0, 9))) for i in range(n)]


def test_insert_if_absent_against_brute_force(spark):
    target = [(f"k{i}", -1, 0.0) for i in range(20)]
    batch = random_rows(1, 300, range(10, 40))
    want = {r[0]: r for r in target}
    for r in batch:
        want.setdefault(r[0], r)
    got = merge.insert_if_absent(frame(spark, target), frame(spark, batch), ["k"], ["seq"])
    assert rows_of(got) == sorted(want.values())


def test_insert_twice_is_once(spark):
    target, batch = frame(spark, [("a", 0, 1.0)]), frame(spark, [("a", 1, 2.0), ("b", 2, 3.0), ("b", 1, 4.0)])
    once = merge.insert_if_absent(target, batch, ["k"], ["seq"])
    assert rows_of(merge.insert_if_absent(once, batch, ["k"], ["seq"])) == rows_of(once) == [("a", 0, 1.0), ("b", 1, 4.0)]
    assert merge.new_rows(once, batch, ["k"]).count() == 0


def test_null_keys_never_enter(spark):
    got = merge.insert_if_absent(frame(spark, []), frame(spark, [(None, 1, 1.0), ("a", 1, 1.0)]), ["k"])
    assert rows_of(got) == [("a", 1, 1.0)]


def test_null_values_survive(spark):
    got = merge.first_per_key(frame(spark, [("a", 1, None), ("a", 2, 5.0), ("b", 1, float("nan"))]), ["k"], ["seq"])
    assert [(r.k, r.seq, str(r.v)) for r in got.orderBy("k").collect()] == [("a", 1, "None"), ("b", 1, "nan")]


def test_one_key_with_a_third_of_the_rows(spark):
    df = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id"))).alias("k"),
        F.col("id").cast("int").alias("seq"),
        F.lit(1.0).alias("v"),
    )
    got = merge.insert_if_absent(frame(spark, []), df, ["k"], ["seq"])
    assert got.count() == 60_001
    assert got.filter("k = 'hot'").first()["seq"] == 0


def test_upsert_last_writer_wins(spark):
    target = [(f"k{i}", -1, 0.0) for i in range(20)]
    batch = random_rows(2, 300, range(10, 40))
    want = {r[0]: r for r in target} | {r[0]: r for r in batch}
    got = merge.upsert(frame(spark, target), frame(spark, batch), ["k"], ["seq"])
    assert rows_of(got) == sorted(want.values())


def test_key_only_table(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert [r.k for r in merge.first_per_key(df, ["k"]).collect()] == ["a"]


def test_unique_check(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 1.0)])
    assert [tuple(r) for r in merge.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]
    merge.assert_unique(df, ["k", "seq"])
    with pytest.raises(ValueError):
        merge.assert_unique(df, ["k"])


def test_unscored_leaves_out_unscorable(spark):
    trips = spark.createDataFrame([("a",), ("b",), ("c",)], "trip_id string")
    left = merge.unscored(trips, trips.filter("trip_id = 'a'"), trips.filter("trip_id = 'b'"))
    assert [r.trip_id for r in left.collect()] == ["c"]


def test_small_batch_does_not_shuffle_a_large_target(spark, tmp_path):
    path, small = str(tmp_path / "t"), str(tmp_path / "b")
    spark.range(200_000).selectExpr("concat('k', id) AS k", "cast(id AS int) AS seq", "1D AS v").write.parquet(path)
    frame(spark, [("k1", 1, 1.0), ("new", 1, 1.0)]).write.parquet(small)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100KB")
    try:
        fresh = merge.new_rows(spark.read.parquet(path), spark.read.parquet(small), ["k"])
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    semi = plan.split("LeftSemi")[1].splitlines()
    scan = next(i for i, line in enumerate(semi) if "FileScan" in line and "/t]" in line)
    assert "BroadcastHashJoin" in plan.split("LeftSemi")[0].splitlines()[-1]
    assert not any("Exchange" in line for line in semi[:scan])
    assert rows_of(fresh) == [("new", 1, 1.0)]
