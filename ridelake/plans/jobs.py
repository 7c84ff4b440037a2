"""The four scheduled jobs and request scoring, as plain functions.

Each takes its dates as arguments and can be run again for the same dates.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridelake.ml import features as ft
from ridelake.ml import model as ml
from ridelake.operators.enrich import enrich_trips
from ridelake.operators.firstn import first_by_time
from ridelake.operators.merge import unscored
from ridelake.operators.slices import align, between_days, request_defaults, trailing, training_slice, with_default_time
from ridelake.operators.stats import zone_daily_stats
from ridelake.plans.warehouse import Warehouse
from ridelake.schemas import (
    ENRICHED_DAYS,
    ENRICHED_STORED,
    KEYS,
    MODEL_METRICS,
    MODEL_REGISTRY,
    RAW_STORED,
    RAW_TRIPS,
    TRIP_PREDICTIONS,
    TRIPS_ENRICHED,
    ZONE_DAILY_STATS,
    ZONE_STORED,
)
from ridelake.sources import tables

UNSCORABLE = StructType([StructField("trip_id", StringType(), True)])


def land_trips(spark: SparkSession, wh: Warehouse, source: DataFrame, start: dt.date, end: dt.date) -> int:
    """Copy trips created in [start, end) from another store into raw trips; returns the new ones.

    ``source`` may be a database table: the range becomes part of its scan, and
    the rows are staged so that it is scanned once.
    """
    rows = tables.stamped(align(between_days(source, "created_at", start, end), RAW_TRIPS), "created_at")
    with tables.staged(rows, "raw") as batch:
        return tables.merge_absent(batch, wh.raw_trips, RAW_STORED, KEYS["raw_trips"], by=["dt"], few_files=True)


def daily_etl(
    spark: SparkSession,
    wh: Warehouse,
    as_of: dt.date,
    run_ts: dt.datetime,
    until: dt.date | None = None,
    prune_by_day: bool = False,
) -> dict[str, int]:
    """Raw trips created in [as_of, until) to raw zone, enriched table and zone statistics.

    The enriched rows are written once, to the raw zone; both later steps read
    them back from there. No task recomputes them and none are held in memory.

    By default a trip is looked for in the whole enriched table before it is
    inserted. ``prune_by_day`` looks on ``as_of`` only: enough when raw trips
    are unique and the slices of different runs do not overlap, because a
    repeat can then only come from the same day run again.
    """
    end = until or as_of + dt.timedelta(days=1)
    landed = tables.read_parquet(spark, wh.raw_trips, RAW_STORED).filter(
        (F.col("dt") >= F.lit(as_of)) & (F.col("dt") < F.lit(end))
    )
    raw = between_days(landed, "created_at", as_of, end)
    rows = align(with_default_time(enrich_trips(raw), "trips_enriched", run_ts), TRIPS_ENRICHED)
    dated = rows.withColumn("dt", F.lit(as_of))
    written = tables.overwrite_partitions(dated, wh.raw_zone, "dt")
    if not written:
        # An overwrite by partitions leaves those alone that no row belongs to.
        tables.drop(spark, f"{wh.raw_zone}/dt={as_of}")
        tables.drop(spark, f"{wh.zone_daily_stats}/stat_date={as_of}")
    batch = tables.read_parquet(spark, wh.raw_zone, ZONE_STORED).filter(F.col("dt") == F.lit(as_of))
    among = F.col("dt") == F.lit(as_of) if prune_by_day else None
    inserted = insert_enriched(wh, batch, among)
    stats = align(with_default_time(zone_daily_stats(batch, as_of), "zone_daily_stats", run_ts), ZONE_DAILY_STATS)
    # The whole day is replaced, so a zone that a repeated run no longer has leaves no row.
    zones = tables.overwrite_partitions(stats, wh.zone_daily_stats, "stat_date", few_files=True)
    return {"enriched": written, "inserted": inserted, "zones": zones}


def enriched_table(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """The enriched trips, as they lie in buckets of their key."""
    return tables.keyed(spark, wh.trips_enriched, ENRICHED_STORED, KEYS["trips_enriched"][0], wh.buckets, ENRICHED_DAYS)


def predictions_table(spark: SparkSession, wh: Warehouse) -> DataFrame:
    """The scored trips, in the same buckets as the enriched ones."""
    return tables.keyed(spark, wh.predictions, TRIP_PREDICTIONS, KEYS["trip_predictions"][0], wh.buckets)


def insert_enriched(wh: Warehouse, batch: DataFrame, among: Column | None = None) -> int:
    """Insert the trips of ``batch`` that the enriched table lacks; returns their number."""
    rows = tables.stamped(batch, "processed_at", "processed_day")
    return tables.merge_absent(
        rows, wh.trips_enriched, ENRICHED_STORED, KEYS["trips_enriched"], by=ENRICHED_DAYS, among=among, buckets=wh.buckets
    )


def train_fares(
    spark: SparkSession,
    wh: Warehouse,
    run_ts: dt.datetime,
    days: int = 90,
    max_iter: int = 100,
    fit_on: str = "all",
) -> str:
    """Train on the last ``days`` days, log the metrics row, register the model; returns its version."""
    first_day = (run_ts - dt.timedelta(days=days)).date()
    stored = enriched_table(spark, wh).filter(F.col("processed_day") >= F.lit(first_day))
    rows = ft.labelled(training_slice(trailing(stored, "processed_at", run_ts, days)))
    fitted = ft.fit_features(rows, fit_on)
    version, path = f"gbt_fare_{run_ts:%Y%m%d}", wh.run(f"gbt_fare_{run_ts:%Y%m%d}", run_ts)
    # Written out, so that training and evaluation do not derive it again.
    prepared = tables.overwrite(fitted.transform(rows).select("features", "label", "trip_id"), f"{path}/prepared")
    train, test = ft.hash_split(tables.read_parquet(spark, f"{path}/prepared"))
    ml.save(fitted, ml.train(ml.dealt(train, "trip_id", prepared), max_iter), path)
    # What is registered is measured as it was saved.
    _, model = ml.load(path)
    with tables.staged(ml.evaluate(test, model, version, run_ts), "metrics") as metrics:
        tables.replace_rows(align(metrics, MODEL_METRICS), wh.metrics, MODEL_METRICS, KEYS["model_metrics"])
        entry = metrics.withColumns({"path": F.lit(path), "created_at": F.col("train_date")})
        tables.replace_rows(align(entry, MODEL_REGISTRY), wh.registry, MODEL_REGISTRY, KEYS["model_registry"])
    return version


def load_latest(
    spark: SparkSession, wh: Warehouse, min_r2: float | None = None
) -> tuple[str, PipelineModel, GBTRegressionModel] | None:
    """The newest good model of the registry, or None if there is none."""
    registry = tables.table_or_empty(spark, wh.registry, MODEL_REGISTRY)
    row = ml.latest_model(registry, min_r2).first()
    return None if row is None else (row["model_version"], *ml.load(row["path"]))


def _need_model(
    spark: SparkSession, wh: Warehouse, min_r2: float | None
) -> tuple[str, PipelineModel, GBTRegressionModel]:
    loaded = load_latest(spark, wh, min_r2)
    if loaded is None:
        raise LookupError("no good model is registered yet; run train_fares first")
    return loaded


def score_batch(
    spark: SparkSession, wh: Warehouse, run_ts: dt.datetime, cap: int | None = None, min_r2: float | None = None
) -> int:
    """Score the trips that have no prediction; returns the number of predictions written.

    Trips the model cannot use are listed once and then left out, so that with
    a cap they do not fill every batch.
    """
    _, features, model = _need_model(spark, wh, min_r2)
    known = tables.keyed(spark, wh.unscorable, UNSCORABLE, "trip_id", wh.buckets)
    left = unscored(enriched_table(spark, wh), predictions_table(spark, wh), known)
    tables.append_keyed(ft.unscorable(left), wh.unscorable, UNSCORABLE, "trip_id", wh.buckets)
    left = ft.scorable(left)
    if cap is not None:
        left = first_by_time(left, cap, "request_time", "trip_id")
    rows = with_default_time(ml.score_trips(left, features, model), "trip_predictions", run_ts)
    # The anti joins above left only trips without a prediction, also when a
    # broken run is repeated, so an append keeps one row per trip.
    return tables.append_keyed(align(rows, TRIP_PREDICTIONS), wh.predictions, TRIP_PREDICTIONS, "trip_id", wh.buckets)


def add_feedback(spark: SparkSession, wh: Warehouse, run_ts: dt.datetime, tol: float = 0.20) -> int:
    """Insert well-predicted trips the enriched table lacks; returns their number."""
    rows = ml.feedback_rows(predictions_table(spark, wh), run_ts, tol).withColumn("dt", F.lit(run_ts.date()))
    return insert_enriched(wh, rows)


def score_requests(
    spark: SparkSession, wh: Warehouse, requests: DataFrame, key: str | None = None, min_r2: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Fares for a table or stream of requests, and the requests that were rejected."""
    version, features, model = _need_model(spark, wh, min_r2)
    accepted, rejected = request_defaults(requests)
    return ml.score_requests(accepted, features, model, version, key), rejected
