import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridelake.functions import geo
from ridelake.operators.enrich import add_geo_columns, enrich_trips, min_distance, with_coordinates
from ridelake.operators.grids import heat_grid, kde_grid
from ridelake.operators import zones
from tests.conftest import plan_of

POINTS = "trip_id string, origin_lat double, origin_lng double, dest_lat double, dest_lng double, request_time timestamp_ntz"
# Places, their distances and their zones.
SEEDS = [
    ("T001", -6.2088, 106.8456, -6.1751, 106.8272, 4.2637, "Jakarta Pusat", "Jakarta Pusat"),
    ("T002", -6.1751, 106.8272, -6.2297, 106.8295, 6.0766, "Jakarta Pusat", "Lainnya"),
    ("T003", -6.2297, 106.8295, -6.1588, 106.8461, 8.0945, "Lainnya", "Lainnya"),
    ("T004", -6.1944, 106.8229, -6.2615, 106.7871, 8.4457, "Jakarta Pusat", "Jakarta Selatan"),
    ("T005", -6.2615, 106.7871, -6.2088, 106.8456, 8.7266, "Jakarta Selatan", "Jakarta Pusat"),
]
# Points on the borders of zones.
EDGES = [
    (-6.20, 106.82, "Jakarta Pusat"),
    (-6.20, 106.87, "Jakarta Pusat"),
    (-6.12, 106.75, "Jakarta Utara"),
    (-6.14, 106.90, "Jakarta Utara"),
    (-6.30, 106.90, "Jakarta Selatan"),
    (-6.155, 106.85, "Lainnya"),
    (None, 106.85, "Unknown"),
    (-6.2, None, "Unknown"),
    (float("nan"), 106.85, "Lainnya"),
    (float("inf"), 106.85, "Lainnya"),
]


def trips(spark, rows):
    import datetime as dt

    return spark.createDataFrame([(*r, dt.datetime(2024, 1, 7, 13, 5)) for r in rows], POINTS)


def test_seed_trips(spark):
    got = enrich_trips(trips(spark, [s[:5] for s in SEEDS])).orderBy("trip_id").collect()
    assert [(r.trip_id, r.distance_km, r.origin_zone, r.dest_zone) for r in got] == [(s[0], *s[5:]) for s in SEEDS]
    assert {(r.hour_of_day, r.day_of_week) for r in got} == {(13, 1)}


def test_zone_edges_both_ways(spark):
    df = spark.createDataFrame([(i, *e[:2]) for i, e in enumerate(EDGES)], "id int, lat double, lng double")
    case = df.select("id", geo.zone_case(F.col("lat"), F.col("lng")).alias("z"))
    joined = zones.assign_zone(df, zones.zone_table(spark), "lat", "lng", "z")
    for got in (case, joined):
        assert [r.z for r in got.orderBy("id").collect()] == [e[2] for e in EDGES]


@pytest.mark.parametrize("limit", [zones.BROADCAST_ZONES, 0])
def test_zone_join_equals_case_on_either_path(spark, monkeypatch, limit):
    monkeypatch.setattr(zones, "BROADCAST_ZONES", limit)
    random.seed(3)
    rows = [(i, random.uniform(-6.4, -6.05), random.uniform(106.65, 107.02)) for i in range(3000)]
    rows += [(3000 + i, lat, lng) for i, (lat, lng, _) in enumerate(EDGES)]
    df = spark.createDataFrame(rows, "id int, lat double, lng double")
    joined = zones.assign_zone(df, zones.zone_table(spark), "lat", "lng", "z")
    both = joined.withColumn("case", geo.zone_case(F.col("lat"), F.col("lng")))
    assert both.count() == len(rows)
    assert both.filter("z <> case OR z IS NULL").count() == 0
    assert "NestedLoop" not in plan_of(joined) and "Cartesian" not in plan_of(joined)


@pytest.mark.parametrize("limit", [zones.BROADCAST_ZONES, 0])
def test_rows_with_equal_or_missing_keys_keep_their_own_zone(spark, monkeypatch, limit):
    monkeypatch.setattr(zones, "BROADCAST_ZONES", limit)
    rows = [(None if i % 2 else 7, lat, lng) for i, (lat, lng, _) in enumerate(EDGES)] * 2
    df = spark.createDataFrame(rows, "id int, lat double, lng double")
    joined = zones.assign_zone(df, zones.zone_table(spark), "lat", "lng", "z")
    case = df.withColumn("z", geo.zone_case(F.col("lat"), F.col("lng")))
    assert sorted(map(str, joined.collect())) == sorted(map(str, case.collect()))


@pytest.mark.parametrize("limit", [zones.BROADCAST_ZONES, 0])
def test_boxes_of_any_size(spark, monkeypatch, limit):
    monkeypatch.setattr(zones, "BROADCAST_ZONES", limit)
    rng = random.Random(8)
    boxes = [("country", -11.0, 6.0, 95.0, 141.0, 90), ("world", -90.0, 90.0, -180.0, 180.0, 99), ("none", 1.0, 0.0, 1.0, 2.0, 1), ("point", -6.0, -6.0, 106.0, 106.0, 0)]
    for i in range(60):
        lat, lng, size = rng.uniform(-10, 5), rng.uniform(96, 140), 10 ** rng.uniform(-3, 1)
        boxes.append((f"b{i}", lat, lat + size * rng.random(), lng, lng + size * rng.random(), rng.randrange(2, 80)))
    table = spark.createDataFrame(boxes, zones.ZONE_SCHEMA)
    leveled = zones._level(table.filter("lat_min <= lat_max"), 0.05)
    for level in {r.level for r in leveled.collect()}:
        covered = zones._by_cell(leveled.filter(F.col("level") == level), 0.05 * 2.0**level)
        assert max(r["count"] for r in covered.groupBy("zone").count().collect()) <= (zones.SPAN + 2) ** 2
    points = [(i, rng.uniform(-15, 10), rng.uniform(90, 145)) for i in range(500)] + [(500, -6.0, 106.0), (501, None, 1.0), (502, 95.0, 500.0)]
    points += [(510 + i, b[1], b[3]) for i, b in enumerate(boxes)]
    df = spark.createDataFrame(points, "id int, lat double, lng double")
    got = {r.id: r.z for r in zones.assign_zone(df, table, "lat", "lng", "z").collect()}
    for i, lat, lng in points:
        held = [(b[5], b[0]) for b in boxes if lat is not None and b[1] <= lat <= b[2] and b[3] <= lng <= b[4]]
        assert got[i] == (min(held)[1] if held else "Unknown" if lat is None else "Lainnya")


def test_no_zones_at_all(spark):
    df = spark.createDataFrame([(1, -6.2, 106.85), (2, None, 1.0)], "id int, lat double, lng double")
    empty = spark.createDataFrame([], zones.ZONE_SCHEMA)
    got = zones.assign_zone(df, empty, "lat", "lng", "z").orderBy("id").collect()
    assert [r.z for r in got] == ["Lainnya", "Unknown"]


def plain_km(a, b, c, d):
    """Radius times the angle between the two unit vectors, from their cross and dot products."""
    p, q = (
        np.array([math.cos(math.radians(y)) * math.cos(math.radians(x)), math.cos(math.radians(y)) * math.sin(math.radians(x)), math.sin(math.radians(y))])
        for y, x in ((a, b), (c, d))
    )
    return geo.EARTH_RADIUS_KM * math.atan2(float(np.linalg.norm(np.cross(p, q))), float(p @ q))


def test_haversine_properties(spark):
    random.seed(11)
    rows = [tuple(random.uniform(-lim, lim) for lim in (90, 180, 90, 180)) for _ in range(3000)]
    rows += [(0.0, 0.0, 0.0, 180.0), (90.0, 0.0, -90.0, 0.0), (5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    there = geo.haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    back = geo.haversine_km(F.col("c"), F.col("d"), F.col("a"), F.col("b"))
    for r in df.select("*", there.alias("km"), back.alias("back")).collect():
        assert r.km >= 0 and abs(r.km - r.back) <= 1e-4
        assert abs(r.km - plain_km(*r[:4])) <= 6e-5
        assert (r.km == 0) == (r[:2] == r[2:4])


def test_bad_coordinates_are_null_or_nan_and_filtered(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(None, 1.0), (1.0, None), (nan, 1.0), (1.0, nan), (inf, 1.0), (1.0, -inf)]
    rows = [(f"a{i}", *p, 2.0, 2.0) for i, p in enumerate(bad)] + [(f"b{i}", 2.0, 2.0, *p) for i, p in enumerate(bad)]
    df = trips(spark, rows)
    kms = {r.trip_id: r.distance_km for r in add_geo_columns(df).collect()}
    assert all(kms[f"{s}{i}"] is None for s in "ab" for i in (0, 1))
    assert all(math.isnan(kms[f"{s}{i}"]) for s in "ab" for i in (2, 3, 4, 5))
    assert min_distance(add_geo_columns(df)).count() == 0
    assert enrich_trips(df).count() == 0
    assert with_coordinates(df).count() == 4  # infinity is a value


def test_distance_limit_is_strict(spark):
    df = spark.createDataFrame([(0.3,), (0.3001,), (None,), (float("nan"),)], "distance_km double")
    assert [r[0] for r in min_distance(df).collect()] == [0.3001]


def test_sql_functions(spark):
    geo.register_sql_functions(spark)
    df = spark.sql(
        "SELECT haversine_km(-6.2088D, 106.8456D, -6.1751D, 106.8272D) AS km, haversine_km(null, 1D, 1D, 1D) AS none, "
        "zone_of(-6.2D, 106.85D) AS z, zone_of(null, 106.85D) AS u, zone_of(0D, 0D) AS o"
    )
    assert tuple(df.first()) == (4.2637, None, "Jakarta Pusat", "Unknown", "Lainnya")
    assert "Python" not in plan_of(df)


def test_null_checks_reach_the_scan_of_stored_trips(spark, tmp_path):
    trips(spark, [s[:5] for s in SEEDS]).write.parquet(str(tmp_path / "t"))
    df = enrich_trips(spark.read.parquet(str(tmp_path / "t"))).select("trip_id", "distance_km")
    plan = plan_of(df)
    assert "IsNotNull(origin_lat)" in plan and "request_time" not in plan.split("ReadSchema")[-1]


def test_grids(spark):
    df = spark.createDataFrame(
        [(0.5, 0.5)] * 3 + [(1.5, 0.5)] + [(None, 0.1), (float("nan"), 0.1)], "origin_lat double, origin_lng double"
    )
    heat = {(r.cell_lat, r.cell_lng): (r.trips, r.weight) for r in heat_grid(df, cell=1.0).collect()}
    assert heat == {(0, 0): (3, 1.0), (1, 0): (1, 1 / 3)}
    kde = {(r.cell_lat, r.cell_lng): r.density for r in kde_grid(df, cell=1.0, radius=1).collect()}
    assert len(kde) == 12
    assert kde[(0, 0)] == pytest.approx(3 + math.exp(-0.5))
    assert kde[(-1, -1)] == pytest.approx(3 * math.exp(-1))
