"""Time parts and labels. Days run from 1 (Sunday) to 7 everywhere."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_free(moment: dt.datetime) -> Column:
    """A time literal without a zone, whatever the zones of the session and of this machine."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    return F.dayofweek(ts)


def date_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def model_version(ts: Column, prefix: str = "gbt_fare_") -> Column:
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyyMMdd"))


def minute_index(ts: Column) -> Column:
    """Minutes since 1970 of a zone-free time, whatever the session's zone."""
    days = F.datediff(F.to_date(ts), F.lit(dt.date(1970, 1, 1))).cast("bigint")
    return days * F.lit(1440) + F.hour(ts) * F.lit(60) + F.minute(ts)


def milli_of_minute(ts: Column) -> Column:
    return F.floor(F.extract(F.lit("SECOND"), ts) * F.lit(1000)).cast("int")
