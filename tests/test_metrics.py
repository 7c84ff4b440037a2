import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ridelake.operators import metrics

LOG = "id int, ts timestamp_ntz, label string"
START = dt.datetime(2024, 3, 1, 0, 0)


def log_rows(seed, n):
    random.seed(seed)
    rows = [(i, START + dt.timedelta(seconds=random.randint(0, 1800)), random.choice("ab")) for i in range(n)]
    burst = START + dt.timedelta(minutes=7)
    rows += [(n + i, burst, "a") for i in range(n // 2)]
    edge = [burst + dt.timedelta(minutes=5), burst + dt.timedelta(minutes=5, microseconds=1)]
    return rows + [(2 * n + i, t, "a") for i, t in enumerate(edge)]


def test_increase_against_brute_force(spark):
    rows = log_rows(1, 400)
    df = spark.createDataFrame(rows, LOG).repartition(4)
    window = dt.timedelta(minutes=5)
    got = {r.id: r.increase for r in metrics.increase(df, window).collect()}
    want = {i: sum(1 for _, u, m in rows if m == l and t - window <= u <= t) for i, t, l in rows}
    assert got == want


def test_increase_does_not_put_a_label_in_one_window(spark):
    df = spark.createDataFrame(log_rows(1, 10), LOG)
    plan = metrics.increase(df, dt.timedelta(minutes=5))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 3
    # over single events only within a minute; over a whole label only the minutes' totals
    assert sum("minute" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in windows) == 2


def test_counter_increase_with_restarts(spark):
    samples = [(0, 10.0), (60, 12.0), (120, 3.0), (290, 5.0), (310, 9.0), (600, 9.0), (1500, 1.0)]
    rows = [(START + dt.timedelta(seconds=s), "a", v) for s, v in samples] + [(START, "b", 4.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, label string, value double")
    got = {(r.label, (r.window_start - START).seconds): r.increase for r in metrics.counter_increase(df).collect()}
    assert got == {("a", 0): 2 + 3 + 2, ("a", 300): 4.0, ("a", 600): 0.0, ("a", 1500): 1.0, ("b", 0): 0.0}


def test_sliding_counter_increase_against_brute_force(spark):
    random.seed(4)
    rows = [(START + dt.timedelta(seconds=random.randint(0, 4000)), random.choice("ab"), float(random.randint(0, 50))) for _ in range(300)]
    window = dt.timedelta(minutes=7)
    df = spark.createDataFrame(rows + [(START, None, 1.0), (None, "a", 1.0), (START, "a", None)], "ts timestamp_ntz, label string, value double")
    got = {(r.label, r.ts): r.increase for r in metrics.counter_increase_sliding(df.repartition(4), window).collect()}
    want = {}
    for label in "ab":
        series = {}
        for t, l, v in rows:
            if l == label:
                series[t] = max(v, series.get(t, v))
        times = sorted(series)
        grown = {t: series[t] - series[p] if series[t] >= series[p] else series[t] for p, t in zip(times, times[1:])}
        want |= {(label, t): sum(g for u, g in grown.items() if t - window <= u <= t) for t in times}
    assert got == want


def test_several_quantiles_are_those_taken_one_by_one(spark):
    random.seed(6)
    rows = [(START + dt.timedelta(seconds=i), random.choice("ab"), random.random() * 7) for i in range(500)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, label string, value double")
    together = {(r.window_start, r.label): r for r in metrics.histogram_quantiles(df, {"p50": 0.5, "p99": 0.99}).collect()}
    for name, q in (("p50", 0.5), ("p99", 0.99)):
        for r in metrics.histogram_quantile(df, q).collect():
            assert together[r.window_start, r.label][name] == r.quantile


def test_rate_per_minute(spark):
    rows = [(i, START + dt.timedelta(seconds=20 * i), "ok" if i % 2 else "error") for i in range(9)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, status string")
    got = {(r.minute_start, r.status): r.per_minute for r in metrics.rate_per_min(df).collect()}
    assert got[(START, "error")] == 2 and got[(START, "ok")] == 1 and sum(got.values()) == 9


def plain_quantile(values, q, bounds):
    cum = [sum(v <= b for v in values) for b in bounds]
    rank = q * len(values)
    for i, c in enumerate(cum):
        if c >= rank:
            low, before = (bounds[i - 1], cum[i - 1]) if i else (0.0, 0)
            return low + (bounds[i] - low) * (rank - before) / (c - before) if c > before else None
    return bounds[-1]


@pytest.mark.parametrize("q", [0.5, 0.95, 0.99])
def test_histogram_quantile(spark, q):
    random.seed(9)
    sets = {w: [random.expovariate(2.0) for _ in range(random.randint(1, 40))] for w in range(12)}
    sets[12], sets[13] = [9.0] * 5, [0.001]
    rows = [(START + dt.timedelta(minutes=5 * w, seconds=1), "a", v) for w, vs in sets.items() for v in vs]
    rows.append((START, "a", None))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, label string, value double")
    got = {r.window_start: r for r in metrics.histogram_quantile(df, q).collect()}
    for w, vs in sets.items():
        r = got[START + dt.timedelta(minutes=5 * w)]
        assert r.n == len(vs)
        assert r["quantile"] == pytest.approx(plain_quantile(vs, q, metrics.LATENCY_BOUNDS))


def test_buckets_and_status(spark):
    df = spark.createDataFrame([("a", 0.01), ("a", 0.02), ("a", 7.0), ("b", None)], "label string, value double")
    got = {(r.label, r.le): (r.cumulative, r.n) for r in metrics.buckets(df).collect()}
    assert got[("a", 0.01)] == (1, 3) and got[("a", 0.05)] == (2, 3) and got[("a", 5.0)] == (2, 3)
    assert got[("b", 5.0)] == (0, 0) and len(got) == 16
    assert {r.label: r.n for r in metrics.by_status(df, "label").collect()} == {"a": 3, "b": 1}


def test_latest_level(spark):
    rows = [("a", 0, 2.0), ("a", 9, 0.4), ("b", 0, 0.5), ("c", 0, 1.0), ("c", 5, None), ("d", 0, 0.99)]
    df = spark.createDataFrame(
        [(l, START + dt.timedelta(seconds=s), v) for l, s, v in rows], "label string, ts timestamp_ntz, value double"
    )
    got = {r.label: r.level for r in metrics.latest_level(df).collect()}
    assert got == {"a": "green", "b": "yellow", "c": "red", "d": "yellow"}
    runs = metrics.latest_level(df.withColumn("value", F.col("value") * 100), levels=((50.0, "slow"),), calm="fine")
    assert {r.label: r.level for r in runs.collect()} == {"a": "fine", "b": "slow", "c": "slow", "d": "slow"}


def test_latest_value_of_one_instant_is_the_largest(spark):
    rows = [("a", dt.datetime(2024, 1, 1), v) for v in (0.1, 5.0, 0.2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "label string, ts timestamp_ntz, value double").coalesce(1)
        assert metrics.latest_level(df).first().last_value == 5.0
