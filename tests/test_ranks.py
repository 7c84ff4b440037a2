"""Quantiles and first-n against brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelake.operators import firstn, quantiles

PROBS = {"low": 0.0, "q1": 0.25, "mid": 0.5, "q3": 0.75, "p99": 0.99, "high": 1.0}


def samples():
    rng = np.random.default_rng(5)
    return {
        "one": [3.5],
        "two": [1.0, 2.0],
        "same": [7.0] * 50,
        "uniform": rng.uniform(-5, 5, 2001).tolist(),
        "skew": [500.0] * 700 + rng.exponential(1e4, 300).tolist(),
        "far": [-1e300, 1e300, *rng.normal(0, 1e-3, 500).tolist()],
        "tiny": (1.0 + rng.integers(0, 50, 400) * 2.0**-50).tolist(),
    }


@pytest.mark.parametrize(("buckets", "bounded"), [(65_536, 1_000_000), (65_536, 20), (65_536, 0), (16, 100), (16, 0)])
@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_quantiles_are_exact(spark, monkeypatch, buckets, bounded, broadcast):
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "BOUNDED", bounded)
    monkeypatch.setattr(quantiles, "BROADCAST_RANGES", broadcast)
    rows = [(g, v) for g, values in samples().items() for v in values]
    rows += [("uniform", None), ("uniform", float("nan")), ("nothing", None)]
    random.seed(1)
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r for r in quantiles.quantiles_by(df, "g", "x", PROBS).collect()}
    assert set(got) == set(samples())
    for g, values in samples().items():
        for name, p in PROBS.items():
            if g == "far" and name == "p99":
                continue
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12), (g, name)


def test_ordinals_keep_the_order(spark):
    edge = [math.ldexp(1.0, e) for e in range(-1074, 1024)]
    near = [math.nextafter(x, way) for x in edge for way in (0.0, math.inf)]
    values = sorted({v * s for v in [*edge, *near, 0.0, math.inf, 1.7976931348623157e308] for s in (1, -1)})
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = [r[0] for r in rows.orderBy("i").select(quantiles.ordinal(F.col("x"))).collect()]
    assert got == sorted(got) and got[0] == -got[-1] and len(set(got)) > len(edge) * 2


def test_far_values_leave_a_bounded_range(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BOUNDED", 50)
    rows = spark.range(20_000).select(F.lit("g").alias("grp"), (F.col("id") * 0.37 + 1e4).alias("x"))
    far = spark.createDataFrame([("g", 1e15), ("g", -1e300), ("g", math.inf)], "grp string, x double")
    found, several = quantiles.ranges(rows.unionByName(far), {"mid": 0.5, "top": 0.999})
    found = found.collect()
    assert len(found) == 3 and several <= 3 and max(r.n for r in found) <= 50
    mid = next(r for r in found if r.rank == 10_001)
    assert mid.lo <= 1e4 + 10_000 * 0.37 <= mid.hi and mid.below <= 10_001 < mid.below + mid.n


def test_median_order_and_null_group(spark):
    df = spark.createDataFrame([("b", 1.0), ("b", 3.0), ("a", 9.0), (None, 1.0)], "g string, x double")
    assert [tuple(r) for r in quantiles.median_by(df, "g", "x").collect()] == [("b", 2.0), ("a", 9.0)]


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, 100.0, -50.0]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double")
    r = quantiles.boxplot_by(df, "g", "x").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    kept = [v for v in values if q1 - reach <= v <= q3 + reach]
    assert (r.q1, r.q3) == pytest.approx((q1, q3))
    assert (r.whisker_low, r.whisker_high, r.outliers) == (min(kept), max(kept), len(values) - len(kept))


def test_bad_probability(spark):
    with pytest.raises(ValueError):
        quantiles.quantiles_by(spark.range(1), "id", "id", {"p": 1.5})


def times(seed, n):
    random.seed(seed)
    base = dt.datetime(1969, 12, 31, 23, 58)
    rows = [(f"k{i:04d}", base + dt.timedelta(microseconds=random.randint(0, 300_000_000))) for i in range(n)]
    hot = [(f"h{i:04d}", dt.datetime(1970, 1, 1, 0, 0, 30, 500)) for i in range(n // 2)]
    return [*rows, *hot, ("none", None)]


@pytest.mark.parametrize("n", [1, 2, 37, 200, 449, 450, 451, 10_000])
def test_first_by_time(spark, n):
    rows = times(4, 300)
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz").repartition(4)
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or dt.datetime.min, r[0]))[:n]
    assert [tuple(r) for r in firstn.first_by_time(df, n, "t", "k").collect()] == want


@pytest.mark.parametrize("n", [1, 50, 500, 5_000])
def test_hash_sample(spark, n):
    import hashlib

    keys = [f"k{i}" for i in range(700)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    want = sorted(keys, key=lambda k: (int(hashlib.md5(k.encode()).hexdigest()[:8], 16), k))[:n]
    assert [r.k for r in firstn.hash_sample(df, n, "k").collect()] == want


def test_the_time_limit_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts")
    plan = firstn.first_by_time(df, 10, "ts", "event_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(ts,ScalarSubquery" in plan


def test_only_rows_up_to_the_cut_are_sorted(spark):
    df = spark.range(100_000).select(F.concat(F.lit("k"), "id").alias("k"))
    taken = firstn.hash_sample(df, 100, "k")
    taken.collect()
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Subquery" in plan
