"""The first n rows of a very large table in a total order.

A sort with a limit keeps n rows per input task and merges all of them in one
task: with n in the thousands and many thousands of tasks that merge is too
large. Here the leading sort key is counted in coarse buckets, then the one
bucket that holds the n-th row is counted in fine ones; only rows up to that
fine bucket are sorted. Each count has a bounded number of groups, so tasks
send on far fewer rows than they read.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.times import milli_of_minute, minute_index, zone_free


def _reached(df: DataFrame, bucket: Column, n: Column, before: Column) -> DataFrame:
    """The bucket that holds row number ``n`` and the rows before it; empty if there are fewer rows.

    The window runs over the buckets' counts, not over rows.
    """
    counts = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = before + F.sum("n").over(order)
    return (
        counts.withColumn("upto", upto)
        .filter((F.col("upto") >= n) & (F.col("upto") - F.col("n") < n))
        .select(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before")).alias("cut"))
    )


def first_n(
    df: DataFrame,
    n: int,
    coarse: Column,
    fine: Column,
    order: Sequence[str | Column],
    limit_of: Callable[[DataFrame], DataFrame] | None = None,
    limited: str | None = None,
) -> DataFrame:
    """First ``n`` rows by ``order``.

    ``(coarse, fine)`` must never decrease along ``order``, and both must have
    a bounded number of values. All rows are returned when there are fewer
    than ``n``. ``limit_of`` may turn the coarse bucket into a value that the
    column ``limited`` stays below; a plain comparison with it reaches the scan.
    """
    reached = _reached(df, coarse, F.lit(n), F.lit(0))
    near = df
    if limit_of is not None and limited is not None:
        near = df.filter(F.col(limited).isNull() | (F.col(limited) < limit_of(reached.select("cut.bucket")).scalar()))
    first = reached.scalar()
    inside = near.filter(coarse.eqNullSafe(first.getField("bucket")))
    second = _reached(inside, fine, F.lit(n), first.getField("before")).scalar()
    cut = F.struct(first.getField("bucket").alias("coarse"), second.getField("bucket").alias("fine"))
    kept = F.struct(coarse.alias("coarse"), fine.alias("fine")) <= cut
    return near.filter(first.isNull() | kept).orderBy(*order).limit(n)


def _end_of_minute(minutes: DataFrame) -> DataFrame:
    """End of the one minute given, or the end of time if there is none."""
    day, minute = F.floor(F.col("bucket") / 1440).cast("int"), F.pmod("bucket", F.lit(1440)).cast("int")
    end = zone_free(dt.datetime(1970, 1, 1)) + F.make_dt_interval(days=day, mins=minute + 1)
    return minutes.agg(F.coalesce(F.max(end), zone_free(dt.datetime.max)))


def first_by_time(df: DataFrame, n: int, ts: str, key: str) -> DataFrame:
    """First ``n`` rows by time, then key: buckets are the minute and the millisecond."""
    t = F.col(ts)
    return first_n(df, n, minute_index(t), milli_of_minute(t), [ts, key], _end_of_minute, ts)


def hash_rank(key: str) -> Column:
    """32-bit hash of a key, the same in every engine that has MD5."""
    return F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint")


def hash_sample(df: DataFrame, n: int, key: str) -> DataFrame:
    """``n`` rows spread evenly over the table, the same rows on every run.

    The rows with the smallest key hash are taken, so neither file order nor
    partitioning matters and hash buckets are even by construction.
    """
    rank = hash_rank(key)
    coarse, fine = F.shiftright(rank, 20), F.shiftright(rank, 8).bitwiseAND(F.lit(0xFFF))
    return first_n(df, n, coarse, fine, [rank, F.col(key)])
