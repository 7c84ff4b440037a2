"""Distance, zones and service area as plain columns (no Python UDF)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The radius that distances use, and the names of places without a zone.
EARTH_RADIUS_KM = 6371.0
NO_COORDINATES = "Unknown"
NO_ZONE = "Lainnya"


@dataclass(frozen=True)
class Box:
    zone: str
    lat_min: float
    lat_max: float
    lng_min: float
    lng_max: float


# The service zones. The boxes are closed and overlap; where two
# hold a point the one listed first wins.
ZONE_BOXES = (
    Box("Jakarta Pusat", -6.22, -6.16, 106.82, 106.87),
    Box("Jakarta Utara", -6.15, -6.07, 106.73, 106.97),
    Box("Jakarta Selatan", -6.37, -6.24, 106.77, 106.91),
    Box("Jakarta Barat", -6.22, -6.10, 106.68, 106.82),
    Box("Jakarta Timur", -6.35, -6.13, 106.87, 107.00),
)

# The rectangle trips are generated in.
SERVICE_AREA = Box("service area", -6.37, -6.07, 106.68, 107.00)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, digits: int = 4) -> Column:
    """Great-circle distance; null if any input is null, NaN if any is NaN or infinite."""
    chord = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    km = F.round(F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord))), digits)
    # least() ranks NaN above every number and so turns it into 1. Zero times
    # the inputs adds nothing to a real distance and brings NaN back.
    real = F.lit(0.0) * (lat1 + lng1 + lat2 + lng2)
    # least() also skips null; the sum does not.
    return km + real


def in_box(lat: Column, lng: Column, box: Box) -> Column:
    return lat.between(box.lat_min, box.lat_max) & lng.between(box.lng_min, box.lng_max)


def zone_case(lat: Column, lng: Column, zones: Sequence[Box] = ZONE_BOXES) -> Column:
    """Zone of a point for a short fixed list of boxes: one CASE expression, no join."""
    label = F.when(lat.isNull() | lng.isNull(), F.lit(NO_COORDINATES))
    for box in zones:
        label = label.when(in_box(lat, lng, box), F.lit(box.zone))
    return label.otherwise(F.lit(NO_ZONE))


def in_service_area(lat: Column, lng: Column, area: Box = SERVICE_AREA) -> Column:
    """Quality flag: false outside the area and for missing coordinates."""
    return F.coalesce(in_box(lat, lng, area), F.lit(False))


def register_sql_functions(spark: SparkSession) -> None:
    """Expose ``haversine_km`` and ``zone_of`` to SQL text.

    Both have SQL bodies, so Catalyst sees through them.
    """
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION haversine_km"
        "(lat1 DOUBLE, lng1 DOUBLE, lat2 DOUBLE, lng2 DOUBLE) RETURNS DOUBLE RETURN "
        f"round({2 * EARTH_RADIUS_KM}D * asin(sqrt(least(1D, pow(sin(radians(lat2 - lat1) / 2), 2) + "
        "cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lng2 - lng1) / 2), 2)))), 4) "
        "+ 0D * (lat1 + lng1 + lat2 + lng2)"
    )
    branches = " ".join(
        f"WHEN lat BETWEEN {b.lat_min}D AND {b.lat_max}D AND lng BETWEEN {b.lng_min}D AND {b.lng_max}D "
        f"THEN '{b.zone}'"
        for b in ZONE_BOXES
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION zone_of(lat DOUBLE, lng DOUBLE) RETURNS STRING RETURN "
        f"CASE WHEN lat IS NULL OR lng IS NULL THEN '{NO_COORDINATES}' {branches} ELSE '{NO_ZONE}' END"
    )
