"""Trip tables derived from an ``events`` table.

The driver's tables hold no trips. ``events`` has a unique id and a time of
day, and integer arithmetic on its id yields coordinates, vehicles, surge and
weather, with defects (missing latitude, missing weather, zero-length trips,
missing or zero fares) planted at known places.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.functions.fares import round_to, tariff
from ridelake.operators.enrich import add_geo_columns, enrich_trips
from ridelake.schemas import EVENTS

AS_OF = dt.date(2024, 1, 15)
LAST_DAY = dt.date(2024, 1, 30)

# The mapping, in text both Spark and standard SQL engines parse.
TRIP_COLUMNS = {
    "trip_id": "concat('T', CAST(event_id AS STRING))",
    "driver_id": "concat('D', CAST(1000 + (event_id * 31) % 9000 AS STRING))",
    "passenger_id": "concat('P', CAST(1000 + user_id AS STRING))",
    "origin_lat": "CASE WHEN event_id % 97 = 5 THEN NULL "
    "ELSE CAST(-6370000 + (event_id * 7919 + 13) % 300001 AS DOUBLE) / 1e6 END",
    "origin_lng": "CAST(106680000 + (event_id * 104729 + 7) % 320001 AS DOUBLE) / 1e6",
    "dest_lat": "CAST(-6370000 + (CASE WHEN event_id % 89 = 3 THEN event_id * 7919 + 13 "
    "ELSE event_id * 15485863 + 101 END) % 300001 AS DOUBLE) / 1e6",
    "dest_lng": "CAST(106680000 + (CASE WHEN event_id % 89 = 3 THEN event_id * 104729 + 7 "
    "ELSE event_id * 32452843 + 17 END) % 320001 AS DOUBLE) / 1e6",
    "request_time": "ts",
    "vehicle_type": "CASE (event_id + user_id) % 3 WHEN 0 THEN 'motor' WHEN 1 THEN 'car' ELSE 'premium' END",
    "surge_multiplier": "CASE WHEN event_id % 6 < 3 THEN 1.0e0 WHEN event_id % 6 = 3 THEN 1.2e0 "
    "WHEN event_id % 6 = 4 THEN 1.5e0 ELSE 2.0e0 END",
    "weather": "CASE WHEN event_id % 107 = 13 THEN NULL WHEN (event_id * 11 + event_id % 5) % 6 < 3 THEN 'sunny' "
    "WHEN (event_id * 11 + event_id % 5) % 6 < 5 THEN 'rain' ELSE 'heavy_rain' END",
    "created_at": "ts",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trips, with the event id kept for ordering."""
    return events(spark, sf_dir).selectExpr("event_id", *[f"{sql} AS {name}" for name, sql in TRIP_COLUMNS.items()])


def add_fare(df: DataFrame) -> DataFrame:
    """Fare by tariff, spread by up to ten percent, in steps of 500."""
    listed = tariff(F.col("distance_km"), F.col("vehicle_type"), F.col("surge_multiplier"), F.col("weather"))
    spread = (F.lit(90) + F.col("event_id") % 21).cast("double")
    fare = (
        F.when(F.col("event_id") % 101 == 7, F.lit(None).cast("double"))
        .when(F.col("event_id") % 103 == 11, F.lit(0.0))
        .otherwise(round_to(listed * spread / F.lit(100.0)))
    )
    return df.withColumn("actual_fare", fare)


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All trips with geo columns and fare, before any filter."""
    return add_fare(add_geo_columns(trips(spark, sf_dir)))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_fare(enrich_trips(trips(spark, sf_dir)))


def predictions(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Predicted fares up to 30 percent off; every seventh trip is still unscored. ``more`` columns of the trips stay."""
    off = (F.lit(70) + F.col("event_id") % 61).cast("double")
    return (
        enriched(spark, sf_dir)
        .filter(F.col("event_id") % 7 != 0)
        .withColumn("predicted_fare", F.col("actual_fare") * off / F.lit(100.0))
        .select(
            "trip_id", "origin_lat", "origin_lng", "dest_lat", "dest_lng", "distance_km", "vehicle_type",
            "surge_multiplier", "weather", "hour_of_day", "day_of_week", "origin_zone", "predicted_fare",
            "actual_fare", *more,
        )
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scoring requests: optional fields are left out where they hold the common value."""
    return located(spark, sf_dir).select(
        "trip_id", "origin_lat", "origin_lng", "dest_lat", "dest_lng", "distance_km", "vehicle_type",
        F.nullif("surge_multiplier", F.lit(1.0)).alias("surge_multiplier"),
        "weather", "hour_of_day", "day_of_week",
        F.nullif("origin_zone", F.lit("Lainnya")).alias("origin_zone"),
        F.nullif("dest_zone", F.lit("Lainnya")).alias("dest_zone"),
    )


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log: (ts, label, status, value in seconds)."""
    return events(spark, sf_dir).select(
        "event_id", "ts", F.col("event_type").alias("label"), F.col("event_type").alias("status"),
        (F.col("value") / F.lit(100.0)).alias("value"),
    )
