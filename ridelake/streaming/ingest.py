"""Streaming jobs: landing events and keeping the day's zone statistics current."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ridelake.operators.enrich import enrich_trips
from ridelake.operators.slices import align, with_default_time
from ridelake.operators.stats import add_up, measures, sums_by_day
from ridelake.schemas import KEYS, RAW_STORED, RAW_TRIPS, ZONE_DAILY_STATS
from ridelake.sources import tables
from ridelake.streaming.events import ARRIVAL, decode


def _utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def ingest(
    raw: DataFrame,
    target: str,
    dead_letter: str,
    checkpoint: str,
    clock: Callable[[], dt.datetime] = _utc_now,
    prune_by_day: bool = False,
    available_now: bool = True,
    interval: str = "10 seconds",
) -> StreamingQuery:
    """Land a stream of JSON ``value`` rows in the raw trips table.

    Every micro-batch inserts the trips whose id the table lacks and appends
    the rest to the dead-letter table. Of a batch's trips with one id the first
    by ``arrival`` stays, if the stream has that column. A batch that is run again after a
    failure changes nothing: its trips are already there, and its dead letters
    replace the partition that carries its number.

    The table is partitioned by the day a trip landed. With ``prune_by_day``
    an id is looked for from the earliest request day of the batch on: enough
    when a repeated trip repeats its request time, as no trip lands before it
    is requested.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        if ARRIVAL in batch.columns:
            # A task reads a block of a file in order, so within it rows are numbered by place.
            batch = batch.withColumn(ARRIVAL, F.struct(ARRIVAL, F.monotonically_increasing_id().alias("row")))
        # Only dead letters need their text again; of the others it would be most of what is kept.
        decoded = decode(batch).withColumn("value", F.when(F.col("error").isNotNull(), F.col("value")))
        decoded = decoded.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            good = decoded.filter(F.col("error").isNull())
            order = [c for c in good.columns if c == ARRIVAL]
            wanted = StructType([*RAW_TRIPS.fields, *[good.schema[c] for c in order]])
            trips = align(with_default_time(good, "raw_trips", clock()), wanted)
            tables.merge_absent(
                tables.stamped(trips, "created_at"), target, RAW_STORED, KEYS["raw_trips"], order, by=["dt"],
                among=_since_first_request(trips) if prune_by_day else None, few_files=True,
            )
            bad = decoded.filter(F.col("error").isNotNull()).select(
                "value", "error", F.lit(batch_id).cast("bigint").alias("batch_id")
            )
            tables.overwrite_partitions(bad, dead_letter, "batch_id", few_files=True)
        finally:
            decoded.unpersist()

    return _start(raw, land, checkpoint, "append", available_now, interval)


def _since_first_request(trips: DataFrame) -> Column | None:
    """Landing days on which a repeat of these trips can be; all days if a request time is missing."""
    known = trips.agg(
        F.min("request_time").cast("date").alias("first"), F.count_if(F.col("request_time").isNull()).alias("missing")
    ).first()
    return None if known["missing"] or known["first"] is None else F.col("dt") >= F.lit(known["first"])


def added(state: DataFrame, delta: DataFrame, batch_id: int) -> DataFrame:
    """The days of ``delta`` with the sums of one batch added to the rows of ``state`` that have not seen it."""
    keys = ["stat_date", "zone"]
    held = state.join(F.broadcast(delta.select("stat_date").distinct()), "stat_date", "left_semi")
    seen = held.filter(F.col("batch_id") >= batch_id)
    new = delta.join(seen, keys, "left_anti").withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    return add_up(held.unionByName(new), keys, F.max("batch_id").alias("batch_id"))


def keep_zone_stats(
    raw_trips: DataFrame,
    table: str,
    checkpoint: str,
    clock: Callable[[], dt.datetime] = _utc_now,
    available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Enrich a stream of landed trips and keep the zone statistics of their days current.

    A trip counts on the day it landed, ``created_at``, as in the daily job, so
    both write the same rows. The state is a table of sums beside the
    checkpoint: a batch adds its sums to the days it has trips of, however
    long ago those are, and only these days are written. A batch that is run again
    after a failure finds its number in the rows it has already reached.
    """
    state_path = f"{checkpoint.rstrip('/')}/zone_sums"

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # Landing sets both keys; a trip without a landing time counts on no day.
        delta = sums_by_day(enrich_trips(batch)).filter(F.col("stat_date").isNotNull())
        schema = StructType([*delta.schema.fields, StructField("batch_id", LongType(), True)])
        state = tables.table_or_empty(spark, state_path, schema).select(*schema.fieldNames())
        with tables.staged(added(state, delta, batch_id), "zone-sums") as sums:
            stats = measures(sums, "stat_date", "zone")
            rows = align(with_default_time(stats, "zone_daily_stats", clock()), ZONE_DAILY_STATS)
            # State last: a failure between the two is mended by the batch's second run.
            tables.overwrite_partitions(rows, table, "stat_date", few_files=True)
            tables.overwrite_partitions(sums, state_path, "stat_date", few_files=True)

    return _start(raw_trips, merge, checkpoint, "append", available_now, interval)


def _start(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    available_now: bool,
    interval: str,
) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
