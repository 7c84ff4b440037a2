"""Rolling figures over metric series: rows of (time, label, value)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.times import minute_index

# Upper bounds, in seconds, of the latency histogram.
LATENCY_BOUNDS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)
# Lowest 95th-percentile latency, in seconds, of each warning level.
LATENCY_LEVELS = ((1.0, "red"), (0.5, "yellow"))
CALM = "green"

_FROM_START = (Window.unboundedPreceding, Window.currentRow)


def _running_total(points: DataFrame, label: str, ts: str, delta: str, out: str) -> DataFrame:
    """Running total of ``delta`` per label in time order, equal times included.

    Prefix sums on two levels: the minutes of a label are summed up, then the
    seconds of a minute. Every second of a label is summed by itself, after one
    extra row that carries the total of what lies before it and sorts first,
    having no time. No task sees a whole label or a whole minute of one. The
    extra rows are part of the result.
    """
    points = points.withColumn("second", minute_index(F.col(ts)) * F.lit(60) + F.second(ts))
    seconds = points.groupBy(label, "second").agg(F.sum(delta).alias("sum")).withColumn("minute", F.floor(F.col("second") / F.lit(60)))
    minutes = seconds.groupBy(label, "minute").agg(F.sum("sum").alias("minute_sum"))
    until = F.sum("minute_sum").over(Window.partitionBy(label).orderBy("minute").rowsBetween(*_FROM_START))
    minutes = minutes.select(label, "minute", (until - F.col("minute_sum")).alias("minutes_before"))
    in_minute = Window.partitionBy(label, "minute").orderBy("second").rowsBetween(*_FROM_START)
    before = F.col("minutes_before") + F.sum("sum").over(in_minute) - F.col("sum")
    carried = seconds.join(minutes, [label, "minute"]).select(label, "second", before.alias(delta))
    inside = Window.partitionBy(label, "second").orderBy(ts).rangeBetween(*_FROM_START)
    rows = points.unionByName(carried, allowMissingColumns=True)
    return rows.withColumn(out, F.sum(delta).over(inside)).drop("second")


def increase(df: DataFrame, window: dt.timedelta, ts: str = "ts", label: str = "label") -> DataFrame:
    """Add ``increase``: events of the same label in the ``window`` up to each event, both ends included.

    An event counts from its own time until the window has passed: +1 then and
    -1 afterwards, so the figure is a running total of changes. Events at the
    same instant are counted first, which bounds a second of one label by the
    clock's resolution however many events it has.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(ts).isNotNull())
    counted = known.groupBy(label, ts).agg(F.count(F.lit(1)).alias("n"))
    return known.join(_within(counted, window, ts, label), [label, ts])


def _within(points: DataFrame, window: dt.timedelta, ts: str, label: str) -> DataFrame:
    """(label, ts, increase): sum of ``n`` over the ``window`` up to each point; points are unique by label and time."""
    leave = F.col(ts) + F.lit(window + dt.timedelta(microseconds=1))
    steps = F.array(
        F.struct(F.col(ts).alias("at"), F.col("n").alias("delta"), F.lit(True).alias("arrives")),
        F.struct(leave.alias("at"), (-F.col("n")).alias("delta"), F.lit(False).alias("arrives")),
    )
    totals = _running_total(points.select(label, F.inline(steps)), label, "at", "delta", "increase")
    return totals.filter("arrives").select(label, F.col("at").alias(ts), "increase")


def _growth(df: DataFrame, window: str, ts: str, label: str) -> DataFrame:
    """(label, ts, window_start, grown): growth of a counter since its sample before; null at a label's first.

    A sample below the one before it marks a restart: the counter then grew by
    its whole new value. Samples are compared within a window; the first with
    the last of the label's previous window.
    """
    start = F.window(ts, window).start
    samples = df.groupBy(label, ts).agg(F.max("value").alias("value")).withColumn("window_start", start)
    edges = samples.groupBy(label, "window_start").agg(F.max_by("value", ts).alias("last"))
    before = edges.select(
        label,
        "window_start",
        F.lag("last").over(Window.partitionBy(label).orderBy("window_start")).alias("before"),
    )
    previous = F.coalesce(
        F.lag("value").over(Window.partitionBy(label, "window_start").orderBy(ts)), F.col("before")
    )
    grown = F.when(F.col("value") < F.col("previous"), F.col("value")).otherwise(
        F.col("value") - F.col("previous")
    )
    found = samples.join(before, [label, "window_start"]).withColumn("previous", previous)
    return found.select(label, ts, "window_start", grown.alias("grown"))


def counter_increase(df: DataFrame, window: str = "5 minutes", ts: str = "ts", label: str = "label") -> DataFrame:
    """Growth of a counter per label and tumbling window, from its samples (ts, label, value).

    Growth between windows counts in the later one; a restart counts the whole new value.
    """
    grown = _growth(df, window, ts, label)
    return grown.groupBy("window_start", label).agg(F.coalesce(F.sum("grown"), F.lit(0.0)).alias("increase"))


def counter_increase_sliding(
    df: DataFrame, window: dt.timedelta, ts: str = "ts", label: str = "label", slice_: str = "5 minutes"
) -> DataFrame:
    """(label, ts, increase): growth of a counter in the ``window`` up to each of its samples, both ends included.

    Neighbouring samples are compared in tumbling slices, which do not change the result.
    """
    known = df.filter(F.col(label).isNotNull() & F.col(ts).isNotNull() & F.col("value").isNotNull())
    grown = _growth(known, slice_, ts, label)
    return _within(grown.select(label, ts, F.coalesce("grown", F.lit(0.0)).alias("n")), window, ts, label)


def rate_per_min(df: DataFrame, ts: str = "ts", status: str = "status") -> DataFrame:
    """Events per minute and status."""
    return (
        df.groupBy(F.window(ts, "1 minute").alias("w"), status)
        .agg(F.count(F.lit(1)).alias("per_minute"))
        .select(F.col("w.start").alias("minute_start"), status, "per_minute")
    )


def _cumulative(value: Column, bounds: Sequence[float]) -> list[Column]:
    return [F.count(F.when(value <= b, F.lit(1))).alias(f"le{i}") for i, b in enumerate(bounds)]


def buckets(
    df: DataFrame, bounds: Sequence[float] = LATENCY_BOUNDS, value: str = "value", label: str = "label"
) -> DataFrame:
    """Cumulative histogram per label: one row per bound with the values at or below it."""
    counted = df.groupBy(label).agg(*_cumulative(F.col(value), bounds), F.count(value).alias("n"))
    rows = F.array(
        *[F.struct(F.lit(b).alias("le"), F.col(f"le{i}").alias("cumulative")) for i, b in enumerate(bounds)]
    )
    return counted.select(label, "n", F.inline(rows))


def _interpolated(q: float, bounds: Sequence[float]) -> Column:
    rank = F.lit(float(q)) * F.col("n")
    estimate = None
    for i, upper in enumerate(bounds):
        lower = F.lit(float(bounds[i - 1]) if i else 0.0)
        before = F.col(f"le{i - 1}") if i else F.lit(0)
        inside = F.col(f"le{i}") - before
        point = lower + (F.lit(float(upper)) - lower) * (rank - before) / F.nullif(inside, F.lit(0))
        reached = F.col(f"le{i}") >= rank
        estimate = F.when(reached, point) if estimate is None else estimate.when(reached, point)
    return estimate.otherwise(F.lit(float(bounds[-1])))


def histogram_quantiles(
    df: DataFrame,
    probs: Mapping[str, float],
    bounds: Sequence[float] = LATENCY_BOUNDS,
    window: str = "5 minutes",
    ts: str = "ts",
    value: str = "value",
    label: str = "label",
) -> DataFrame:
    """Quantiles per label and window, one column per entry of ``probs``, interpolated inside the bucket they fall in.

    Ranks above the last bound give that bound. All come from a single
    aggregation with one counter per bound.
    """
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(F.window(ts, window).alias("w"), label)
        .agg(*_cumulative(F.col(value), bounds), F.count(F.lit(1)).alias("n"))
    )
    found = [_interpolated(q, bounds).alias(name) for name, q in probs.items()]
    return counted.select(F.col("w.start").alias("window_start"), label, "n", *found)


def histogram_quantile(df: DataFrame, q: float, *args, **kwargs) -> DataFrame:
    """One quantile per label and window, as column ``quantile``."""
    return histogram_quantiles(df, {"quantile": q}, *args, **kwargs)


def by_status(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count(F.lit(1)).alias("n"))


def latest_level(
    df: DataFrame,
    levels: Sequence[tuple[float, str]] = LATENCY_LEVELS,
    ts: str = "ts",
    value: str = "value",
    label: str = "label",
    calm: str = CALM,
) -> DataFrame:
    """Newest value of every label and its warning level (thresholds from high to low); of values at one instant the largest."""
    newest = (
        df.filter(F.col(value).isNotNull()).groupBy(label).agg(F.max_by(value, F.struct(ts, value)).alias("last_value"))
    )
    level = None
    for bound, name in levels:
        reached = F.col("last_value") >= bound
        level = F.when(reached, F.lit(name)) if level is None else level.when(reached, F.lit(name))
    return newest.withColumn("level", level.otherwise(F.lit(calm)))
