"""Demand, route and fare analyses over enriched trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.functions.fares import tariff


def demand_zone_hour(df: DataFrame) -> DataFrame:
    """Trips per origin zone and hour; rows without either are left out."""
    return (
        df.filter(F.col("origin_zone").isNotNull() & F.col("hour_of_day").isNotNull())
        .groupBy("origin_zone", "hour_of_day")
        .agg(F.count(F.lit(1)).alias("trips"))
    )


def demand_pivot(df: DataFrame) -> DataFrame:
    """Zone by hour table with one column ``h00`` to ``h23`` per hour, zero where there is no trip.

    The hours are fixed, so this is one aggregation and no job to find them.
    """
    hour = F.col("hour_of_day")
    return (
        df.filter(F.col("origin_zone").isNotNull() & hour.isNotNull())
        .groupBy("origin_zone")
        .agg(*[F.count(F.when(hour == h, F.lit(1))).alias(f"h{h:02d}") for h in range(24)])
    )


def top_routes(df: DataFrame, n: int = 10) -> DataFrame:
    """Busiest origin and destination pairs; equal counts in order of the names."""
    return (
        df.filter(F.col("origin_zone").isNotNull() & F.col("dest_zone").isNotNull())
        .groupBy("origin_zone", "dest_zone")
        .agg(F.count(F.lit(1)).alias("trips"))
        .orderBy(F.desc("trips"), "origin_zone", "dest_zone")
        .limit(n)
        .select(F.concat_ws(" → ", "origin_zone", "dest_zone").alias("route"), "trips")
    )


def audit_slice(predictions: DataFrame) -> DataFrame:
    """Scored trips with a known fare, for predicted against actual."""
    return predictions.filter(F.col("actual_fare").isNotNull()).select(
        "trip_id", "actual_fare", "predicted_fare", "origin_zone"
    )


def audit_bounds(predictions: DataFrame) -> DataFrame:
    """Largest fare on either axis of predicted against actual."""
    return audit_slice(predictions).agg(
        F.greatest(F.max("actual_fare"), F.max("predicted_fare")).alias("max_fare"),
        F.count(F.lit(1)).alias("n"),
    )


def residual_audit(df: DataFrame, tol: float = 0.10) -> DataFrame:
    """Share of trips per vehicle whose fare lies within ``tol`` of the tariff."""
    listed = tariff(F.col("distance_km"), F.col("vehicle_type"), F.col("surge_multiplier"), F.col("weather"))
    close = F.abs(F.col("actual_fare") - F.col("tariff")) <= F.lit(tol) * F.col("tariff")
    return (
        df.filter(F.col("actual_fare") > 0)
        .withColumn("tariff", listed)
        .groupBy("vehicle_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.when(close, F.lit(1.0)).otherwise(F.lit(0.0))).alias("within_tolerance"),
        )
    )
