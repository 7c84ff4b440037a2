"""Fare arithmetic: tariff, rounding and the model's label scale."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FARE_STEP = 500

# The tariff, in rupiah. Vehicle: base fare and fare per km.
TARIFF = {
    "motor": (5000.0, 2500.0),
    "car": (10000.0, 4000.0),
    "premium": (25000.0, 8000.0),
}
# Weather factors.
WEATHER_FACTOR = {"sunny": 1.0, "rain": 1.15, "heavy_rain": 1.3}


def _lookup(key: Column, values: Mapping[str, float]) -> Column:
    """The value listed for a key, null for any other."""
    chosen = F.when(F.lit(False), F.lit(None).cast("double"))
    for name, value in values.items():
        chosen = chosen.when(key == name, F.lit(value))
    return chosen


def tariff(distance_km: Column, vehicle_type: Column, surge: Column, weather: Column) -> Column:
    """Fare before noise and rounding.

    An unlisted vehicle has no tariff (null); an unlisted or missing weather
    does not change the fare.
    """
    bases = _lookup(vehicle_type, {name: base for name, (base, _) in TARIFF.items()})
    rates = _lookup(vehicle_type, {name: rate for name, (_, rate) in TARIFF.items()})
    factor = F.coalesce(_lookup(weather, WEATHER_FACTOR), F.lit(1.0))
    return (bases + rates * distance_km) * surge * factor


def round_to(amount: Column, step: int = FARE_STEP) -> Column:
    """Nearest multiple of ``step``, halves to the even multiple."""
    return F.bround(amount / F.lit(float(step)), 0) * F.lit(float(step))


def to_label(fare: Column) -> Column:
    """Currency to the model's log scale."""
    return F.log1p(fare)


def from_label(label: Column) -> Column:
    """Model's log scale back to currency."""
    return F.expm1(label)


def relative_error(predicted: Column, actual: Column) -> Column:
    """|predicted - actual| / actual; null where actual is zero or missing."""
    return F.try_divide(F.abs(predicted - actual), actual)
