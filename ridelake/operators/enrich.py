"""Geo-enrichment of raw trips, usable on batch tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.functions.geo import haversine_km, zone_case
from ridelake.functions.times import day_of_week, hour_of_day

COORDINATES = ["origin_lat", "origin_lng", "dest_lat", "dest_lng"]
MIN_DISTANCE_KM = 0.3


def add_geo_columns(df: DataFrame) -> DataFrame:
    """Distance, zones and time parts; any distance already there is replaced."""
    origin = F.col("origin_lat"), F.col("origin_lng")
    dest = F.col("dest_lat"), F.col("dest_lng")
    return df.withColumns(
        {
            "distance_km": haversine_km(*origin, *dest),
            "origin_zone": zone_case(*origin),
            "dest_zone": zone_case(*dest),
            "hour_of_day": hour_of_day(F.col("request_time")),
            "day_of_week": day_of_week(F.col("request_time")),
        }
    )


def min_distance(df: DataFrame, min_km: float = MIN_DISTANCE_KM) -> DataFrame:
    """Trips longer than ``min_km``. NaN, which ranks above every number, is left out."""
    return df.filter(F.nanvl("distance_km", F.lit(0.0)) > min_km)


def with_coordinates(df: DataFrame) -> DataFrame:
    """Trips whose four coordinates are neither null nor NaN."""
    return df.dropna(subset=COORDINATES)


def enrich_trips(df: DataFrame, min_km: float = MIN_DISTANCE_KM) -> DataFrame:
    """Trips with coordinates that are longer than ``min_km``, with geo columns.

    A distance that is a number has four coordinates that are; the null checks
    are stated as well because they reach the scan.
    """
    located = df
    for name in COORDINATES:
        located = located.filter(F.col(name).isNotNull())
    return min_distance(add_geo_columns(located), min_km)
