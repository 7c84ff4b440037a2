"""Filters and projections that cut a table down to what a job reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelake.functions.fares import relative_error
from ridelake.functions.times import zone_free
from ridelake.schemas import DEFAULT_NOW, SCORING_REQUEST, TRAINING_COLUMNS

# Defaults for the optional fields of a scoring request.
REQUEST_DEFAULTS = {
    "surge_multiplier": 1.0,
    "weather": "sunny",
    "origin_zone": "Jakarta Pusat",
    "dest_zone": "Jakarta Pusat",
}


def _midnight(day: dt.date) -> Column:
    return zone_free(dt.datetime(day.year, day.month, day.day))


def between_days(df: DataFrame, ts: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows with start <= ts < end: a plain range, so it prunes files and row groups."""
    return df.filter((F.col(ts) >= _midnight(start)) & (F.col(ts) < _midnight(end)))


def day_slice(df: DataFrame, ts: str, as_of: dt.date) -> DataFrame:
    return between_days(df, ts, as_of, as_of + dt.timedelta(days=1))


def trailing(df: DataFrame, ts: str, as_of: dt.date | dt.datetime, days: int = 90) -> DataFrame:
    """Rows from the ``days`` days before ``as_of``, and later ones."""
    moment = as_of if isinstance(as_of, dt.datetime) else dt.datetime(as_of.year, as_of.month, as_of.day)
    return df.filter(F.col(ts) >= zone_free(moment - dt.timedelta(days=days)))


def label_valid(df: DataFrame, label: str = "actual_fare") -> DataFrame:
    """Rows whose label is present and positive."""
    return df.filter(F.col(label) > 0)


def training_slice(df: DataFrame) -> DataFrame:
    return label_valid(df).select(*TRAINING_COLUMNS)


def valid_predictions(df: DataFrame, tol: float = 0.20) -> DataFrame:
    """Scored trips whose relative error is at most ``tol``."""
    predicted, actual = F.col("predicted_fare"), F.col("actual_fare")
    return df.filter((predicted > 0) & (actual > 0) & (relative_error(predicted, actual) <= tol))


def request_defaults(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split scoring requests into accepted (defaults filled in) and rejected.

    A request is rejected when a required field is null or NaN, or when its
    day of week lies outside 1 to 7. Extra columns pass through.
    """
    required = [f for f in SCORING_REQUEST if f.name not in REQUEST_DEFAULTS]
    complete = F.col("day_of_week").between(1, 7)
    for field in required:
        complete = complete & F.col(field.name).isNotNull()
        if field.dataType.typeName() == "double":
            complete = complete & ~F.isnan(field.name)
    complete = F.coalesce(complete, F.lit(False))
    accepted = df.filter(complete).withColumns(
        {name: F.coalesce(F.col(name), F.lit(value)) for name, value in REQUEST_DEFAULTS.items()}
    )
    return accepted, df.filter(~complete)


def align(df: DataFrame, schema: StructType) -> DataFrame:
    """Project onto ``schema`` by name: cast what is there, typed null for the rest."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def add_if_absent(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column unless the table already has one of that name."""
    return df if name in df.columns else df.withColumn(name, value)


def with_default_time(df: DataFrame, table: str, run_ts: dt.datetime) -> DataFrame:
    """Fill in the time column a table's rows get when a writer leaves it out."""
    return add_if_absent(df, DEFAULT_NOW[table], moment(run_ts))


def moment(run_ts: dt.datetime) -> Column:
    """A run's own time as a column; operators never read the clock."""
    return zone_free(run_ts)
