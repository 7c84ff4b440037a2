import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelake.ml import features as ft
from ridelake.ml import model as ml
from ridelake.operators import merge
from ridelake.operators.slices import align, training_slice
from ridelake.plans import jobs
from ridelake.plans.warehouse import Warehouse
from ridelake.schemas import (
    MODEL_REGISTRY, RAW_STORED, RAW_TRIPS, TRIP_PREDICTIONS, TRIPS_ENRICHED, ZONE_DAILY_STATS, ZONE_STORED,
)
from ridelake.sources import tables
from ridelake.sources import trips as src
from tests.conftest import plan_of

RUN = dt.datetime(2024, 1, 31, 18)


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.uniform(1e4, 2e5, 500)
    p = a * rng.uniform(0.7, 1.4, 500) + 5e4
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(p, a)] + [(1.0, None)], "predicted_fare double, actual_fare double")
    r = ml.regression_metrics(df).first()
    assert r.n == 500
    assert r.rmse == pytest.approx(math.sqrt(((p - a) ** 2).mean()))
    assert r.mae == pytest.approx(np.abs(p - a).mean())
    assert r.r2 == pytest.approx(1 - ((p - a) ** 2).sum() / ((a - a.mean()) ** 2).sum())


def test_r2_of_constant_values_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "predicted_fare double, actual_fare double")
    assert ml.regression_metrics(df).first()["r2"] == 0.0


def test_unseen_and_missing_categories(spark):
    rows = [("b",), ("b",), ("a",), ("c",), (None,)]
    fitted = ft.indexer(["x"]).fit(spark.createDataFrame(rows, "x string"))
    new = spark.createDataFrame([("b",), ("a",), ("c",), ("new",), (None,)], "x string")
    assert [r.x_idx for r in fitted.transform(new).collect()] == [0.0, 1.0, 2.0, 3.0, 3.0]


def test_ranks_are_those_of_the_indexer(spark, sf):
    trips = src.enriched(spark, sf).select("trip_id", *ft.CATEGORIES)
    indexed = ft.indexer().fit(trips).transform(trips)
    for c in ft.CATEGORIES:
        ranked = ft.indexed_by_rank(indexed, c, ft.frequency_ranks(trips, c), "rank")
        assert ranked.count() == trips.count() and ranked.filter(F.col("rank") != F.col(f"{c}_idx")).count() == 0


@pytest.mark.parametrize("limit", [0, ft.BROADCAST_RANKS])
def test_a_million_categories_are_ranked(spark, monkeypatch, limit):
    monkeypatch.setattr(ft, "BROADCAST_RANKS", limit)
    n = 1_000_000
    # Label k has one row, every thousandth two; the names sort as the numbers do.
    name = F.lpad(F.col("id").cast("string"), 8, "0")
    df = spark.range(n).select(name.alias("c"), F.explode(F.when(F.col("id") % 1000 == 7, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    ranks = ft.frequency_ranks(df.repartition(6), "c")
    assert ranks.agg(F.count("*"), F.min("idx"), F.max("idx"), F.countDistinct("idx")).first()[:] == (n, 0, n - 1, n)
    want = F.when(F.col("id") % 1000 == 7, F.floor(F.col("id") / 1000)).otherwise(F.col("id") + n // 1000 - F.floor((F.col("id") + 993) / 1000))
    ids = ranks.withColumn("id", F.col("label").cast("long")).filter(F.col("idx") != want)
    assert ids.count() == 0
    new = spark.createDataFrame([("00000007",), ("none",), (None,)], "c string")
    assert {r.c: r.i for r in ft.indexed_by_rank(new, "c", ranks, "i").collect()} == {"00000007": 0, "none": n, None: n}


def test_no_categories(spark):
    empty = spark.createDataFrame([], "c string")
    assert ft.frequency_ranks(empty, "c").count() == 0
    assert ft.indexed_by_rank(empty, "c", ft.frequency_ranks(empty, "c"), "i").count() == 0


def test_split_is_stable_and_near_its_share(spark, sf):
    df = src.enriched(spark, sf).select("trip_id")
    train, test = ft.hash_split(df)
    other, _ = ft.hash_split(df.repartition(7))
    assert train.count() + test.count() == df.count()
    assert train.exceptAll(other).count() == 0
    assert 0.75 < train.count() / df.count() < 0.85


def test_unscorable_are_what_the_assembler_skips(spark, sf):
    trips = src.located(spark, sf)
    kept = ft.fit_features(trips).transform(trips).select("trip_id")
    skipped = ft.unscorable(trips).select("trip_id")
    assert skipped.count() > 0
    assert kept.unionByName(skipped).distinct().count() == trips.count() == kept.count() + skipped.count()


def test_fit_on_train_ignores_the_test_side(spark, sf):
    rows = ft.labelled(training_slice(src.enriched(spark, sf)))
    both, train = (ft.fit_features(rows, side).stages[-1].mean.toArray() for side in ("all", "train"))
    assert not np.allclose(both, train)
    with pytest.raises(ValueError):
        ft.fit_features(rows, "test")


def test_latest_model(spark):
    rows = [("v1", "p1", RUN, 1.0, 1.0, 0.95, 10), ("v2", "p2", RUN + dt.timedelta(days=1), 1.0, 1.0, 0.5, 10)]
    registry = spark.createDataFrame(rows, MODEL_REGISTRY)
    assert ml.latest_model(registry).first()["model_version"] == "v2"
    assert ml.latest_model(registry, 0.9).first()["model_version"] == "v1"
    assert ml.latest_model(registry, 0.99).first() is None


def test_training_weight(spark, sf):
    weights = ml.training_weight(src.predictions(spark, sf))
    assert weights.count() == 551 and weights.first()["training_weight"] == 2.0


def test_jobs_end_to_end(spark, sf, tmp_path):
    wh = Warehouse(str(tmp_path / "wh"))
    source = align(src.located(spark, sf), RAW_TRIPS)
    half, end = dt.date(2024, 1, 16), dt.date(2024, 2, 1)
    first = jobs.land_trips(spark, wh, source, dt.date(2024, 1, 1), half)
    assert first + jobs.land_trips(spark, wh, source, dt.date(2024, 1, 10), end) == 1000
    assert spark.read.schema(RAW_STORED).parquet(wh.raw_trips).count() == 1000

    none = jobs.daily_etl(spark, wh, dt.date(2023, 12, 1), RUN)
    assert none == {"enriched": 0, "inserted": 0, "zones": 0}

    first, rest = dt.date(2024, 1, 1), dt.date(2024, 1, 20)
    one = jobs.daily_etl(spark, wh, first, RUN, until=rest)
    two = jobs.daily_etl(spark, wh, rest, RUN, until=end)
    assert one["inserted"] + two["inserted"] == 976
    again = jobs.daily_etl(spark, wh, rest, RUN, until=end, prune_by_day=True)
    assert again["inserted"] == 0 and again["enriched"] == two["enriched"]
    stats = spark.read.schema(ZONE_DAILY_STATS).parquet(wh.zone_daily_stats)
    assert stats.count() == 12 and stats.agg(F.sum("trip_count")).first()[0] == 976

    with pytest.raises(LookupError):
        jobs.score_batch(spark, wh, RUN)
    version = jobs.train_fares(spark, wh, RUN, max_iter=15)
    assert version == "gbt_fare_20240131"
    metrics = spark.read.parquet(wh.metrics).first()
    assert metrics["model_version"] == version and metrics["r2"] > 0.8

    with pytest.raises(LookupError):
        jobs.score_batch(spark, wh, RUN, min_r2=1.01)
    assert jobs.score_batch(spark, wh, RUN, cap=100) == 100
    assert jobs.score_batch(spark, wh, RUN) == 876
    assert jobs.score_batch(spark, wh, RUN) == 0
    scored = spark.read.parquet(wh.predictions)
    assert scored.count() == scored.select("trip_id").distinct().count() == 976

    # All predictions belong to enriched trips, so feedback has nothing to add.
    assert jobs.add_feedback(spark, wh, RUN) == 0

    fares, rejected = jobs.score_requests(spark, wh, src.requests(spark, sf), key="trip_id")
    assert fares.count() + rejected.count() == 1000
    assert fares.filter("predicted_fare_idr % 500 <> 0 OR model_version <> 'gbt_fare_20240131'").count() == 0


def test_stored_trips_are_joined_as_they_lie(spark, sf, tmp_path):
    wh = Warehouse(str(tmp_path / "wh"), buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = align(src.enriched(spark, sf).withColumn("processed_at", F.col("created_at")), TRIPS_ENRICHED)
        rows = rows.withColumn("dt", F.col("processed_at").cast("date"))
        early, late = rows.filter("dt < '2024-01-16'"), rows.filter("dt >= '2024-01-11'")
        assert jobs.insert_enriched(wh, early) == early.count()
        batch = late.unionByName(late)
        stored = jobs.enriched_table(spark, wh)
        plan = plan_of(merge.new_rows(stored, batch, ["trip_id"], buckets=wh.buckets).select("trip_id"))
        target = plan[plan.index("== Physical Plan ==") :].split("FileScan parquet spark_catalog")
        # Above the scan of the target, up to the joins, nothing is moved.
        assert len(target) == 2 and "Exchange" not in target[0][target[0].rindex("SortMergeJoin") :]
        assert jobs.insert_enriched(wh, batch) == rows.count() - early.count()
        assert jobs.insert_enriched(wh, batch) == 0
        stored = jobs.enriched_table(spark, wh)
        assert stored.count() == stored.select("trip_id").distinct().count() == rows.count()
        assert stored.select(*rows.columns).exceptAll(rows).count() == 0

        done = align(src.predictions(spark, sf), TRIP_PREDICTIONS)
        assert tables.append_keyed(done, wh.predictions, TRIP_PREDICTIONS, "trip_id", wh.buckets) == done.count()
        left = merge.unscored(stored, jobs.predictions_table(spark, wh))
        assert "Exchange" not in plan_of(left).split("== Physical Plan ==")[1]
        assert left.count() == rows.count() - done.count()
        since = stored.filter("processed_day >= '2024-01-20'")
        assert "PartitionFilters: [isnotnull(processed_day" in plan_of(since)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_feedback_adds_unknown_trips(spark, sf):
    target = align(src.enriched(spark, sf), ml.TRIPS_ENRICHED)
    assert ml.feedback(src.predictions(spark, sf), target, RUN).count() == 976
    merged = ml.feedback(src.predictions(spark, sf), target.limit(0), RUN)
    assert merged.count() == 551
    row = merged.first()
    assert row.driver_id is None and row.dest_zone is None and row.request_time is None and row.processed_at == RUN


def test_model_learns_the_tariff(spark, sf):
    rows = ft.labelled(training_slice(src.enriched(spark, "/root/testdata/sf0.01")))
    fitted = ft.fit_features(rows)
    train, test = ft.hash_split(fitted.transform(rows))
    metrics = ml.evaluate(test, ml.train(train, 20), "v", RUN).first()
    assert metrics["r2"] > 0.9 and metrics["num_samples"] == test.count()


def test_jobs_can_be_run_again(spark, sf, tmp_path):
    wh = Warehouse(str(tmp_path / "wh"))
    jobs.land_trips(spark, wh, align(src.located(spark, sf), RAW_TRIPS), dt.date(2024, 1, 1), dt.date(2024, 2, 1))
    first, end = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    jobs.daily_etl(spark, wh, first, RUN, until=end)
    for iterations in (1, 3):
        jobs.train_fares(spark, wh, RUN, max_iter=iterations)
    # The repeated run replaces its model, its metrics and its entry together.
    (metrics,), (entry,) = spark.read.parquet(wh.metrics).collect(), spark.read.parquet(wh.registry).collect()
    version, features, model = jobs.load_latest(spark, wh)
    assert model.getNumTrees == 3 and metrics["r2"] == entry["r2"]
    _, test = ft.hash_split(spark.read.parquet(f"{entry['path']}/prepared"))
    assert ml.evaluate(test, model, version, RUN).first()["r2"] == metrics["r2"]
    # Another run on the same day has a place of its own.
    later = RUN + dt.timedelta(minutes=5)
    jobs.train_fares(spark, wh, later, max_iter=2)
    assert len({r["path"] for r in spark.read.parquet(wh.registry).collect()}) == 2
    assert ml.load(entry["path"])[1].getNumTrees == 3 and jobs.load_latest(spark, wh)[2].getNumTrees == 2

    # A run that no longer has a zone leaves no row of it.
    kept = [r.trip_id for r in jobs.enriched_table(spark, wh).filter("origin_zone <> 'Jakarta Pusat'").collect()]
    raw = spark.read.schema(RAW_STORED).parquet(wh.raw_trips).filter(F.col("trip_id").isin(kept))
    tables.overwrite(raw, str(tmp_path / "some"))
    tables.drop(spark, wh.raw_trips)
    tables.overwrite_partitions(spark.read.schema(RAW_STORED).parquet(str(tmp_path / "some")), wh.raw_trips, "dt")
    jobs.daily_etl(spark, wh, first, RUN, until=end)
    zones = {r.zone for r in spark.read.schema(ZONE_DAILY_STATS).parquet(wh.zone_daily_stats).collect()}
    assert "Jakarta Pusat" not in zones and len(zones) == 5

    tables.drop(spark, wh.raw_trips)
    tables.overwrite_partitions(spark.createDataFrame([], RAW_STORED), wh.raw_trips, "dt")
    again = jobs.daily_etl(spark, wh, first, RUN, until=end)
    assert again == {"enriched": 0, "inserted": 0, "zones": 0}
    assert tables.table_or_empty(spark, wh.raw_zone, ZONE_STORED).count() == 0
    assert tables.table_or_empty(spark, wh.zone_daily_stats, ZONE_DAILY_STATS).count() == 0


def test_training_parts_follow_the_cores_not_the_files(spark, sf, tmp_path, monkeypatch):
    wh = Warehouse(str(tmp_path / "wh"), buckets=4)
    trips = align(src.enriched(spark, sf).withColumn("processed_at", F.lit(RUN)), TRIPS_ENRICHED)
    jobs.insert_enriched(wh, tables.stamped(trips, "processed_at"))
    fit, sizes = ml.train, []

    def train(df, iterations):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        try:
            sizes.extend(df.select("label").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        return fit(df, iterations)

    monkeypatch.setattr(ml, "train", train)
    monkeypatch.setattr(ml, "LEAST_ROWS", 10, raising=False)
    jobs.train_fares(spark, wh, RUN, max_iter=1)
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 1.5 * min(sizes)
    prepared = spark.read.parquet(f"{spark.read.parquet(wh.registry).first()['path']}/prepared")
    assert sum(sizes) == ft.hash_split(prepared)[0].count()
    # Of more rows there are several parts a core; a lost part is made again in its order.
    monkeypatch.setattr(ml, "MOST_ROWS", 100)
    parts = ml.dealt(prepared, "trip_id", 900).select("trip_id").rdd.glom().collect()
    assert len(parts) == 12 and all([r[0] for r in part] == sorted(r[0] for r in part) for part in parts)
