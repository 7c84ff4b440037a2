"""Pickup density on a grid of fixed-degree cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_of(coordinate: Column, cell: float) -> Column:
    return F.floor(coordinate / F.lit(cell)).cast("bigint")


def _cells(df: DataFrame, lat: str, lng: str, cell: float) -> DataFrame:
    return (
        df.dropna(subset=[lat, lng])
        .groupBy(cell_of(F.col(lat), cell).alias("cell_lat"), cell_of(F.col(lng), cell).alias("cell_lng"))
        .agg(F.count(F.lit(1)).alias("trips"))
    )


def heat_grid(df: DataFrame, lat: str = "origin_lat", lng: str = "origin_lng", cell: float = 0.01) -> DataFrame:
    """Trips per cell, and their share of the busiest cell."""
    cells = _cells(df, lat, lng, cell)
    busiest = cells.agg(F.max("trips").cast("double")).scalar()
    return cells.withColumn("weight", F.col("trips") / busiest)


def kde_grid(
    df: DataFrame,
    lat: str = "origin_lat",
    lng: str = "origin_lng",
    cell: float = 0.01,
    radius: int = 2,
    sigma: float = 1.0,
) -> DataFrame:
    """Gaussian density per cell: every cell lends its count to its neighbours.

    Trips are counted per cell before they spread, so what is multiplied by the
    neighbourhood is the number of cells, not of trips.
    """
    offsets = [
        F.struct(
            F.lit(dy).cast("bigint").alias("dy"),
            F.lit(dx).cast("bigint").alias("dx"),
            F.lit(math.exp(-(dy * dy + dx * dx) / (2 * sigma * sigma))).alias("w"),
        )
        for dy in range(-radius, radius + 1)
        for dx in range(-radius, radius + 1)
    ]
    return (
        _cells(df, lat, lng, cell)
        .select("cell_lat", "cell_lng", "trips", F.explode(F.array(*offsets)).alias("o"))
        .groupBy(
            (F.col("cell_lat") + F.col("o.dy")).alias("cell_lat"),
            (F.col("cell_lng") + F.col("o.dx")).alias("cell_lng"),
        )
        .agg(F.sum(F.col("trips") * F.col("o.w")).alias("density"))
    )
