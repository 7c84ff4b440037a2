import datetime as dt

import pytest
from pyspark.sql import functions as F

from ridelake.functions import fares, geo, times
from ridelake.operators import analytics, slices, stats
from ridelake.operators.audit import counted, row_count
from ridelake.schemas import SCORING_REQUEST, TRIPS_ENRICHED
from ridelake.sources import objectstore, jdbc
from tests.conftest import plan_of


def test_day_and_trailing_bounds(spark):
    day = dt.date(2024, 1, 15)
    moments = ["2024-01-14 23:59:59.999999", "2024-01-15 00:00:00", "2024-01-15 23:59:59.999999", "2024-01-16 00:00:00"]
    df = spark.createDataFrame([(m,) for m in moments], "m string").select(F.col("m").cast("timestamp_ntz").alias("t"))
    assert slices.day_slice(df, "t", day).count() == 2
    assert slices.trailing(df, "t", dt.date(2024, 1, 16), 1).count() == 3
    assert slices.trailing(df, "t", dt.datetime(2024, 1, 16, 0, 0, 1), 1).count() == 2


def test_day_slice_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").select("ts")
    plan = plan_of(slices.day_slice(df, "ts", dt.date(2024, 1, 15)))
    assert "GreaterThanOrEqual(ts,2024-01-15T00:00)" in plan and "LessThan(ts,2024-01-16T00:00)" in plan


def test_labels_and_valid_predictions(spark):
    rows = [(80.0, 100.0), (120.0, 100.0), (79.9, 100.0), (120.1, 100.0), (1.0, 0.0), (None, 1.0), (1.0, None), (-1.0, -1.0)]
    df = spark.createDataFrame(rows, "predicted_fare double, actual_fare double")
    assert slices.valid_predictions(df).count() == 2
    assert slices.label_valid(df).count() == 5


def test_request_defaults_and_rejects(spark):
    good = (1.0, 2.0, 3.0, 4.0, 5.0, "car", None, None, 8, 1, None, None)
    bad = [good[:i] + (None,) + good[i + 1 :] for i in (0, 1, 2, 3, 4, 5, 8, 9)]
    bad += [(float("nan"), *good[1:]), good[:9] + (0,) + good[10:], good[:9] + (8,) + good[10:]]
    full = (1.0, 2.0, 3.0, 4.0, 5.0, "car", 2.0, "rain", 8, 7, "X", "Y")
    accepted, rejected = slices.request_defaults(spark.createDataFrame([good, full, *bad], SCORING_REQUEST))
    got = {tuple(r) for r in accepted.collect()}
    assert got == {full, (1.0, 2.0, 3.0, 4.0, 5.0, "car", 1.0, "sunny", 8, 1, "Jakarta Pusat", "Jakarta Pusat")}
    assert rejected.count() == len(bad)


def test_align_and_add_if_absent(spark):
    df = slices.align(spark.createDataFrame([("a", 3, "x")], "trip_id string, hour_of_day long, other string"), TRIPS_ENRICHED)
    assert df.schema == TRIPS_ENRICHED
    row = df.first()
    assert (row.trip_id, row.hour_of_day, row.driver_id, row.processed_at) == ("a", 3, None, None)
    run = dt.datetime(2024, 1, 2)
    base = spark.createDataFrame([(1,)], "a int")
    added = slices.add_if_absent(base, "processed_at", slices.moment(run))
    assert added.first()["processed_at"] == run
    assert slices.add_if_absent(added, "processed_at", F.lit(0)).first()["processed_at"] == run


def test_fares(spark):
    rows = [("motor", 2.0, 1.0, "sunny"), ("car", 2.0, 1.5, "rain"), ("premium", 1.0, 2.0, "heavy_rain"), ("car", 1.0, 1.0, None), ("bus", 1.0, 1.0, "rain")]
    df = spark.createDataFrame(rows, "v string, km double, s double, w string")
    got = [r[0] for r in df.select(fares.tariff(F.col("km"), F.col("v"), F.col("s"), F.col("w"))).collect()]
    assert got[:4] == pytest.approx([10000.0, 18000 * 1.5 * 1.15, 33000 * 2 * 1.3, 14000.0]) and got[4] is None
    amounts = [249.0, 250.0, 750.0, 1250.0, 1251.0, -250.0]
    df = spark.createDataFrame([(a,) for a in amounts], "a double")
    assert [r[0] for r in df.select(fares.round_to(F.col("a"))).collect()] == [round(a / 500) * 500 for a in amounts]
    back = fares.from_label(fares.to_label(F.col("a")))
    assert [r[0] for r in df.filter("a > 0").select(back).collect()] == pytest.approx(amounts[:5])


def test_times(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-07 23:15:42.123456' AS t")
    t = F.col("t")
    row = df.select(
        times.hour_of_day(t), times.day_of_week(t), times.date_stamp(t), times.model_version(t), times.minute_index(t),
        times.milli_of_minute(t),
    ).first()
    minutes = int((dt.datetime(2024, 1, 7, 23, 15) - dt.datetime(1970, 1, 1)).total_seconds() // 60)
    assert tuple(row) == (23, 1, "2024-01-07", "gbt_fare_20240107", minutes, 42123)


def test_zone_stats_of_nothing_known(spark):
    df = spark.createDataFrame(
        [("Z", "a", None, 1.0, 1.0, None), ("Z", "b", None, 3.0, 1.0, None), (None, "c", 5.0, 1.0, 1.0, "rain")],
        "origin_zone string, trip_id string, actual_fare double, distance_km double, surge_multiplier double, weather string",
    )
    got = {r.zone: r for r in stats.zone_daily_stats(df, dt.date(2024, 1, 1)).collect()}
    assert tuple(got["Z"]) == (dt.date(2024, 1, 1), "Z", 2, None, 2.0, 1.0, 0)
    assert got[None].rain_trip_count == 1


def test_demand_and_routes_skip_missing_keys(spark):
    df = spark.createDataFrame(
        [("A", "B", 1)] * 2 + [("A", "A", 1)] * 2 + [("B", "A", 23), (None, "A", 1), ("A", None, 2)],
        "origin_zone string, dest_zone string, hour_of_day int",
    )
    pivot = {r.origin_zone: r for r in analytics.demand_pivot(df).collect()}
    assert set(pivot) == {"A", "B"} and pivot["A"].h01 == 4 and pivot["B"].h23 == 1 and pivot["B"].h00 == 0
    assert {(r.origin_zone, r.hour_of_day): r.trips for r in analytics.demand_zone_hour(df).collect()} == {
        ("A", 1): 4, ("A", 2): 1, ("B", 23): 1,
    }
    assert [tuple(r) for r in analytics.top_routes(df, 2).collect()] == [("A → A", 2), ("A → B", 2)]


def test_service_area(spark):
    df = spark.createDataFrame([(-6.37, 107.0), (-6.3701, 107.0), (None, 107.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.in_service_area(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_empty_tables_flow_through(spark, sf):
    from ridelake.ml.model import latest_model, regression_metrics
    from ridelake.schemas import MODEL_REGISTRY, TRIP_PREDICTIONS

    none = spark.createDataFrame([], TRIP_PREDICTIONS)
    assert tuple(regression_metrics(none).first()) == (0, None, None, 0.0)
    assert analytics.audit_bounds(none).first()["max_fare"] is None
    assert slices.valid_predictions(none).count() == 0
    assert latest_model(spark.createDataFrame([], MODEL_REGISTRY)).count() == 0


def test_counts_come_with_the_write(spark, tmp_path):
    df, seen = counted(spark.range(7))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get["rows"] == 7
    assert row_count(spark.range(3)).first()["n"] == 3


def test_object_store_settings():
    conf = objectstore.s3a_settings("http://store:9000", "a", "b")
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert len(conf) == 8
    assert objectstore.dated_path("b", "raw", "trips", "2024-01-01") == "s3a://b/raw/trips_2024-01-01.parquet"


def test_database_options():
    url = jdbc.address("db", "trips")
    assert url == "jdbc:postgresql://db:5432/trips"
    props = jdbc.credentials("u", "p")
    plain = jdbc.read_options(url, "(SELECT 1) AS t", props)
    assert plain["dbtable"] == "(SELECT 1) AS t" and "partitionColumn" not in plain
    split = jdbc.read_options(url, "t", props, "created_at", "2024-01-01", "2024-02-01", 16)
    assert (split["numPartitions"], split["lowerBound"]) == ("16", "2024-01-01")
    with pytest.raises(ValueError):
        jdbc.read_options(url, "t", props, "created_at")
    assert jdbc.write_options(url, "t", props)["batchsize"] == "1000"
    assert jdbc.staging_name("s") != jdbc.staging_name("s")
