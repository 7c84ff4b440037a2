"""A third of all rows on one key, label, instant or value: whole results and no oversized task."""

import bisect
import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ridelake.operators import firstn, merge, metrics, quantiles

N = 60_000
HOT = dt.datetime(2024, 1, 2, 3, 4, 5)
SPLIT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "60KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def split(spark):
    before = {key: spark.conf.get(key, None) for key in SPLIT}
    for key, value in SPLIT.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def rows(split):
    hot = F.col("id") % 3 == 0
    spaced = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))
    return split.range(0, N, 1, 12).select(
        "id",
        F.when(hot, F.lit("hot")).otherwise(F.concat(F.lit("k"), "id")).alias("key"),
        F.when(hot, F.lit("a")).otherwise(F.concat(F.lit("l"), F.col("id") % 4)).alias("label"),
        F.when(hot, F.lit(HOT.isoformat(sep=" ")).cast("timestamp_ntz")).otherwise(spaced).alias("ts"),
        F.when(hot, F.lit(500.0)).otherwise(F.col("id").cast("double")).alias("x"),
    )


def final_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_instant(rows):
    df = metrics.increase(rows.select("id", "label", "ts"), dt.timedelta(minutes=5))
    got = df.collect()
    assert len(got) == N
    assert {r.increase for r in got if r.label == "a"} == {N // 3}
    assert max(r.increase for r in got if r.label != "a") <= 301
    assert "skew" in final_plan(df)


def test_hot_minute_is_dealt_out(split):
    # A third of the events stand in one minute of one label, at instants of their own.
    second = F.when(F.col("id") % 3 == 0, (F.col("id") % 60_000) / 1000).otherwise(F.col("id") * 7)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))
    log = split.range(0, N, 1, 12).select("id", F.lit("a").alias("label"), ts.alias("ts"))
    df = metrics.increase(log, dt.timedelta(minutes=5))
    got = {r.id: r.increase for r in df.collect()}
    times = sorted((r.ts for r in log.collect()))
    want = {r.id: bisect.bisect_right(times, r.ts) - bisect.bisect_left(times, r.ts - dt.timedelta(minutes=5)) for r in log.collect()}
    assert got == want
    # Rows are dealt out by the second; minutes and labels are summed up from sums.
    points = metrics._running_total(log.withColumns({"d": F.lit(1), "label": F.col("id").cast("string")}), "label", "ts", "d", "sum")
    found = re.findall(r"windowspecdefinition\(label#\d+, (\w+)#\d+L?(?:, | ASC)", points._jdf.queryExecution().optimizedPlan().toString())
    assert found == ["second", "minute", "minute"]


def test_hot_key(rows):
    first = merge.first_per_key(rows, ["key"], ["id"])
    assert first.count() == N - N // 3 + 1
    assert first.filter("key = 'hot'").first()["id"] == 0
    fresh = merge.new_rows(rows.filter("id < 1000").select("key"), rows, ["key"], ["id"])
    assert fresh.count() == first.filter("id >= 1000").count()


def test_hot_value(rows):
    whole = rows.withColumn("g", F.lit("g"))
    q = quantiles.quantiles_by(whole, "g", "x", {"low": 0.001, "mid": 0.5, "top": 0.999}).first()
    values = sorted(500.0 if i % 3 == 0 else float(i) for i in range(N))
    for name, p in (("low", 0.001), ("mid", 0.5), ("top", 0.999)):
        at = p * (N - 1)
        low, high = values[int(at)], values[min(N - 1, int(at) + 1)]
        assert q[name] == pytest.approx(low + (high - low) * (at - int(at)))


def test_hot_minute_in_a_capped_batch(rows):
    first = firstn.first_by_time(rows.select("id", "ts"), 50_000, "ts", "id")
    got = first.collect()
    assert len(got) == 50_000
    every = sorted((r.ts, r.id) for r in rows.select("ts", "id").collect())
    assert [(r.ts, r.id) for r in got] == every[:50_000]
