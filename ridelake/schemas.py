"""Table schemas and keys.

Timestamps carry no zone; the session runs in UTC. Counts are 64-bit: a zone
of a large table has more trips than 32 bits hold.
"""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES: dict[str, DataType] = {
    "string": StringType(),
    "double": DoubleType(),
    "int": IntegerType(),
    "long": LongType(),
    "date": DateType(),
    "ts": TimestampNTZType(),
}


def _schema(text: str) -> StructType:
    pairs = (item.split() for item in text.split(","))
    return StructType([StructField(name, _TYPES[kind], True) for name, kind in pairs])


# The tables' columns, in their stored order.
RAW_TRIPS = _schema(
    "trip_id string, driver_id string, passenger_id string, origin_lat double, origin_lng double, "
    "dest_lat double, dest_lng double, request_time ts, distance_km double, vehicle_type string, "
    "surge_multiplier double, weather string, actual_fare double, created_at ts"
)

TRIPS_ENRICHED = _schema(
    "trip_id string, driver_id string, passenger_id string, origin_lat double, origin_lng double, "
    "dest_lat double, dest_lng double, request_time ts, hour_of_day int, day_of_week int, "
    "distance_km double, origin_zone string, dest_zone string, vehicle_type string, "
    "surge_multiplier double, weather string, actual_fare double, processed_at ts"
)

MODEL_METRICS = _schema(
    "model_version string, train_date ts, rmse double, mae double, r2 double, num_samples long, notes string"
)

TRIP_PREDICTIONS = _schema(
    "trip_id string, origin_lat double, origin_lng double, dest_lat double, dest_lng double, "
    "distance_km double, vehicle_type string, surge_multiplier double, weather string, hour_of_day int, "
    "day_of_week int, origin_zone string, predicted_fare double, actual_fare double, predicted_at ts"
)

ZONE_DAILY_STATS = _schema(
    "stat_date date, zone string, trip_count long, avg_fare double, avg_distance_km double, "
    "avg_surge double, rain_trip_count long, updated_at ts"
)

SCORING_REQUEST = _schema(
    "origin_lat double, origin_lng double, dest_lat double, dest_lng double, distance_km double, "
    "vehicle_type string, surge_multiplier double, weather string, hour_of_day int, day_of_week int, "
    "origin_zone string, dest_zone string"
)

MODEL_REGISTRY = _schema(
    "model_version string, path string, created_at ts, rmse double, mae double, r2 double, num_samples long"
)

# One stream event; the zones and time parts an event also carries are
# recomputed later, so they are not part of the stored fields.
TRIP_EVENT = StructType([f for f in RAW_TRIPS if f.name != "created_at"])

EVENTS = _schema("event_id long, ts ts, user_id long, event_type string, value double, props string")

# What the model is trained on.
TRAINING_COLUMNS = [
    "trip_id", "origin_lat", "origin_lng", "dest_lat", "dest_lng", "distance_km", "vehicle_type",
    "surge_multiplier", "weather", "hour_of_day", "day_of_week", "origin_zone", "dest_zone", "actual_fare",
]

# Stored trips carry the days they are partitioned by: the one they landed on, and enriched
# trips first the one they were processed on, which the training window is cut by.
_DAY = StructField("dt", DateType(), True)
RAW_STORED = StructType([*RAW_TRIPS.fields, _DAY])
ZONE_STORED = StructType([*TRIPS_ENRICHED.fields, _DAY])
ENRICHED_STORED = StructType([*TRIPS_ENRICHED.fields, StructField("processed_day", DateType(), True), _DAY])
ENRICHED_DAYS = ["processed_day", "dt"]

# Longest text each stored column takes.
MAX_LENGTH = {
    "trip_id": 50,
    "driver_id": 50,
    "passenger_id": 50,
    "vehicle_type": 20,
    "weather": 20,
    "origin_zone": 30,
    "dest_zone": 30,
    "zone": 30,
    "model_version": 50,
}

KEYS = {
    "raw_trips": ["trip_id"],
    "trips_enriched": ["trip_id"],
    "trip_predictions": ["trip_id"],
    "zone_daily_stats": ["stat_date", "zone"],
    "model_metrics": ["model_version", "train_date"],
    "model_registry": ["model_version", "created_at"],
}

# Columns the store fills in when a writer leaves them out.
DEFAULT_NOW = {
    "raw_trips": "created_at",
    "trips_enriched": "processed_at",
    "trip_predictions": "predicted_at",
    "zone_daily_stats": "updated_at",
    "model_metrics": "train_date",
}
