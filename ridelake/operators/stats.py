"""Zone statistics."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weather that counts as rain.
RAIN = ("rain", "heavy_rain")


# Digits of the averages, and what is counted and averaged.
DIGITS = 4
AVERAGED = {"actual_fare": "avg_fare", "distance_km": "avg_distance_km", "surge_multiplier": "avg_surge"}
SUMS = ["trip_count", *[f"{part}_{c}" for c in AVERAGED for part in ("n", "sum")], "rain_trip_count"]


def zone_sums() -> list[Column]:
    """What the measures of a zone are made of; sums of such rows are such rows again.

    Values are added up as whole units of their last digit, so that the order of
    adding does not show. NaN and infinite values count as missing.
    """
    rainy = F.col("weather").isin(*RAIN)
    columns = [F.count("trip_id").alias("trip_count")]
    for c in AVERAGED:
        units = F.round(F.col(c) * F.lit(10.0**DIGITS)).try_cast("decimal(18,0)")
        columns += [F.count(units).alias(f"n_{c}"), F.coalesce(F.sum(units), F.lit(0)).cast("decimal(38,0)").alias(f"sum_{c}")]
    return [*columns, F.coalesce(F.sum(rainy.cast("int")), F.lit(0)).alias("rain_trip_count")]


def _mean(c: str) -> Column:
    """Mean at DIGITS digits, halves away from zero; null of nothing."""
    n, units = F.col(f"n_{c}").cast("decimal(18,0)"), F.abs(f"sum_{c}")
    doubled = F.call_function("div", units * 2 + n, F.nullif(n * 2, F.lit(0).cast("decimal(19,0)")))
    return F.signum(F.col(f"sum_{c}").cast("double")) * doubled.cast("double") / F.lit(10.0**DIGITS)


def measures(sums: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and the daily measures of a zone from its sums."""
    return sums.select(
        *keys, "trip_count", *[_mean(c).alias(name) for c, name in AVERAGED.items()], "rain_trip_count"
    )


def add_up(sums: DataFrame, keys: Sequence[str], *more: Column) -> DataFrame:
    """One row of sums per key, and ``more`` aggregates."""
    kinds = dict(sums.dtypes)
    return sums.groupBy(*keys).agg(*[F.sum(c).cast(kinds[c]).alias(c) for c in SUMS], *more)


def zone_daily_stats(df: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per origin zone of the whole batch, dated ``as_of``. Averages of nothing stay null, counts become zero."""
    sums = df.groupBy(F.col("origin_zone").alias("zone")).agg(*zone_sums())
    return measures(sums.withColumn("stat_date", F.lit(as_of)), "stat_date", "zone")


def sums_by_day(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """Sums per day of ``ts``, by default the day a trip landed, and origin zone."""
    return df.groupBy(F.col(ts).cast("date").alias("stat_date"), F.col("origin_zone").alias("zone")).agg(*zone_sums())


def zone_stats_by_day(df: DataFrame, ts: str = "created_at") -> DataFrame:
    """One row per day and origin zone; the batch counterpart of the live statistics."""
    return measures(sums_by_day(df, ts), "stat_date", "zone")


def latest(stats: DataFrame, n: int = 50) -> DataFrame:
    """The most recent statistics rows, newest day first."""
    return stats.orderBy(F.desc("stat_date"), "zone").limit(n)
