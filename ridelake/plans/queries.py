"""Registered queries: every operator, run over the driver's tables."""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ridelake.functions import fares, geo, times
from ridelake.ml import features as ft
from ridelake.ml import model as ml
from ridelake.operators import analytics, enrich, grids, merge, metrics, quantiles, slices, stats
from ridelake.operators.audit import row_count
from ridelake.operators.firstn import first_by_time, hash_sample
from ridelake.operators.zones import assign_zone, zone_table
from ridelake.plans import jobs
from ridelake.plans.warehouse import Warehouse
from ridelake.schemas import (
    EVENTS, MODEL_METRICS, MODEL_REGISTRY, RAW_STORED, RAW_TRIPS, TRIP_EVENT, TRIPS_ENRICHED, ZONE_DAILY_STATS,
)
from ridelake.session import shared_dir, tune
from ridelake.sources import tables
from ridelake.sources import trips as src
from ridelake.streaming.events import decode, dedupe, parse_events, read_lines
from ridelake.streaming.ingest import ingest, keep_zone_stats

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

RUN_TS = dt.datetime(2024, 1, 31)
CAP = 1_000
TRAIN_ITERATIONS = 100
LAST_EVENTS = dt.datetime(2024, 1, 30, 12)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = lambda spark, sf: fn(tune(spark), sf)
    return fn


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in names})


# Sources and sinks


@query
def scan_parquet(spark, sf):
    events = tables.read_parquet(spark, f"{sf}/events.parquet", EVENTS)
    return events.select("event_id", "user_id", "event_type", "value")


@query
def scan_project_limit(spark, sf):
    columns = [
        "trip_id", "origin_lat", "origin_lng", "dest_lat", "dest_lng", "origin_zone", "dest_zone", "vehicle_type",
        "actual_fare", "distance_km", "surge_multiplier", "weather", "hour_of_day", "day_of_week",
    ]
    return hash_sample(src.enriched(spark, sf).select(*columns), 50_000, "trip_id")


@query
def raw_zone_copy(spark, sf):
    base = tables.run_path(shared_dir(spark), "zones")
    trips = src.enriched(spark, sf).select("trip_id", "distance_km", "origin_zone", "created_at")
    trips = tables.stamped(trips, "created_at")
    tables.overwrite_partitions(trips, f"{base}/staging", "dt")
    return tables.copy_zone(spark, f"{base}/staging", f"{base}/raw", trips.schema).drop("created_at")


@query
def decode_events(spark, sf):
    props, event = F.col("props"), F.col("event_id")
    cut = F.substring(props, F.lit(1), F.length(props) - 1)
    sent = F.when(event % 13 == 5, cut).when(event % 17 == 3, F.replace(props, F.lit('"k"'), F.lit('"j"'))).otherwise(props)
    raw = spark.read.parquet(f"{sf}/events.parquet").select(sent.alias("value"))
    decoded = decode(raw, StructType([StructField("k", LongType(), True)]), "k")
    return decoded.select("value", "error", F.when(F.col("error").isNull(), F.col("k")).alias("k"))


@query
def merge_insert_if_absent(spark, sf):
    trips = src.enriched(spark, sf).select("trip_id", "actual_fare", "event_id", "created_at")
    target = trips.filter(F.col("created_at") < times.zone_free(dt.datetime(2024, 1, 16)))
    batch = trips.filter(F.col("created_at") >= times.zone_free(dt.datetime(2024, 1, 11)))
    deliveries = F.array(*[F.struct(F.lit(i).alias("delivery"), fare.alias("actual_fare")) for i, fare in (
        (1, F.col("actual_fare")), (2, F.col("actual_fare") + 500),
    )])
    sent = batch.select("trip_id", F.inline(deliveries))
    return merge.insert_if_absent(target.select("trip_id", "actual_fare"), sent, ["trip_id"], ["delivery"])


@query
def keyed_table_merge(spark, sf):
    """The merge of ``merge_insert_if_absent`` on stored tables: the target lies in buckets of its key."""
    path = tables.run_path(shared_dir(spark), "keyed")
    trips = tables.stamped(src.enriched(spark, sf).select("trip_id", "actual_fare", "created_at"), "created_at")
    first, later = (times.zone_free(dt.datetime(2024, 1, d)) for d in (16, 11))
    schema = StructType([trips.schema[c] for c in ("trip_id", "actual_fare", "dt")])
    tables.merge_absent(trips.filter(F.col("created_at") < first), path, schema, ["trip_id"], by=["dt"], buckets=8)
    again = trips.filter(F.col("created_at") >= later).withColumn("actual_fare", F.col("actual_fare") + 500)
    for _ in range(2):  # The second time nothing is absent.
        tables.merge_absent(again, path, schema, ["trip_id"], by=["dt"], buckets=8)
    return tables.keyed(spark, path, schema, "trip_id", 8, ["dt"]).drop("dt")


@query
def daily_load(spark, sf):
    """Two days' runs of the daily job, one of them twice: enriched trips and statistics as stored."""
    wh = Warehouse(tables.run_path(shared_dir(spark), "daily"), buckets=8)
    raw = tables.stamped(slices.align(src.located(spark, sf), RAW_TRIPS), "created_at")
    tables.overwrite_partitions(raw, wh.raw_trips, "dt")
    for day in (src.AS_OF, src.AS_OF + dt.timedelta(days=1), src.AS_OF):
        written = jobs.daily_etl(spark, wh, day, RUN_TS)
    stats_ = tables.read_parquet(spark, wh.zone_daily_stats, ZONE_DAILY_STATS)
    zones = jobs.enriched_table(spark, wh).groupBy("dt", F.col("origin_zone").alias("zone"), "processed_at").agg(
        F.count(F.lit(1)).alias("stored"), F.count_if(F.col("request_time").cast("date") != F.col("dt")).alias("misplaced")
    )
    rows = stats_.join(zones, (F.col("stat_date") == F.col("dt")) & stats_["zone"].eqNullSafe(zones["zone"]) & (F.col("updated_at") == F.col("processed_at")))
    return rows.select("stat_date", stats_["zone"], "trip_count", "avg_fare", "stored", "misplaced", F.lit(written["inserted"]).cast("bigint").alias("inserted_again"))


@query
def merge_upsert(spark, sf):
    by_day = stats.zone_stats_by_day(src.enriched(spark, sf)).select("stat_date", "zone", "trip_count", "avg_fare")
    target = by_day.filter(F.col("stat_date") < dt.date(2024, 1, 20)).withColumn("trip_count", F.col("trip_count") - 1)
    return merge.upsert(target, by_day.filter(F.col("stat_date") >= dt.date(2024, 1, 15)), ["stat_date", "zone"])


@query
def check_unique_key(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    return merge.duplicate_keys(lines, ["l_orderkey", "l_linenumber"])


# Projections and filters


@query
def project_training_slice(spark, sf):
    return slices.training_slice(src.enriched(spark, sf))


@query
def enrich_trips(spark, sf):
    return enrich.enrich_trips(src.trips(spark, sf)).select(
        "trip_id", "distance_km", "origin_zone", "dest_zone", "hour_of_day", "day_of_week"
    )


@query
def filter_min_distance(spark, sf):
    return enrich.min_distance(src.located(spark, sf)).select("trip_id", "distance_km")


@query
def dropna_coordinates(spark, sf):
    return enrich.with_coordinates(src.trips(spark, sf)).select("trip_id", *enrich.COORDINATES)


@query
def filter_label_valid(spark, sf):
    return slices.label_valid(src.enriched(spark, sf)).select("trip_id", "actual_fare")


@query
def feedback_valid_predictions(spark, sf):
    return slices.valid_predictions(src.predictions(spark, sf)).select("trip_id", "predicted_fare", "actual_fare")


@query
def feedback_align(spark, sf):
    rows = ml.feedback_rows(src.predictions(spark, sf), RUN_TS)
    return rows.select(*TRIPS_ENRICHED.fieldNames())


@query
def day_slice(spark, sf):
    return slices.day_slice(src.trips(spark, sf), "created_at", src.AS_OF).select("trip_id", "created_at")


@query
def trailing_window(spark, sf):
    return slices.trailing(src.trips(spark, sf), "created_at", src.LAST_DAY, 7).select("trip_id", "created_at")


@query
def request_defaults(spark, sf):
    accepted, rejected = slices.request_defaults(src.requests(spark, sf))
    shown = ["trip_id", "surge_multiplier", "weather", "origin_zone", "dest_zone"]
    return (
        accepted.select(*shown, F.lit(True).alias("accepted"))
        .unionByName(rejected.select(*shown, F.lit(False).alias("accepted")))
    )


@query
def prediction_audit(spark, sf):
    return hash_sample(analytics.audit_slice(src.predictions(spark, sf)), 5_000, "trip_id")


@query
def prediction_audit_bounds(spark, sf):
    return analytics.audit_bounds(src.predictions(spark, sf))


# Joins


@query
def unscored_trips(spark, sf):
    left = merge.unscored(src.enriched(spark, sf), src.predictions(spark, sf))
    return left.select("trip_id", "request_time", "actual_fare")


@query
def unscored_trips_capped(spark, sf):
    left = merge.unscored(src.enriched(spark, sf), src.predictions(spark, sf)).select("trip_id", "request_time")
    return first_by_time(left, CAP, "request_time", "trip_id")


@query
def zone_assign_case(spark, sf):
    return src.trips(spark, sf).select(
        "trip_id",
        geo.zone_case(F.col("origin_lat"), F.col("origin_lng")).alias("origin_zone"),
        geo.zone_case(F.col("dest_lat"), F.col("dest_lng")).alias("dest_zone"),
    )


@query
def zone_assign_range_join(spark, sf):
    points = src.trips(spark, sf).select("trip_id", "origin_lat", "origin_lng")
    zoned = assign_zone(points, zone_table(spark), "origin_lat", "origin_lng", "origin_zone")
    return zoned.select("trip_id", "origin_zone")


# Aggregations


@query
def zone_daily_stats(spark, sf):
    return stats.zone_daily_stats(src.enriched(spark, sf), src.AS_OF)


@query
def zone_stats_windowed(spark, sf):
    return stats.zone_stats_by_day(src.enriched(spark, sf))


@query
def latest_zone_stats(spark, sf):
    return stats.latest(zone_stats_windowed(spark, sf), 50)


@query
def global_count(spark, sf):
    return row_count(src.trips(spark, sf))


@query
def regression_metrics(spark, sf):
    return _rounded(_rounded(ml.regression_metrics(src.predictions(spark, sf)), 4, "rmse", "mae"), 6, "r2")


@query
def median_fare_by_vehicle(spark, sf):
    medians = quantiles.median_by(src.enriched(spark, sf), "vehicle_type", "actual_fare")
    return _rounded(medians, 4, "median_actual_fare")


@query
def boxplot_fare_by_vehicle(spark, sf):
    boxes = quantiles.boxplot_by(src.enriched(spark, sf), "vehicle_type", "actual_fare")
    return _rounded(boxes, 4, "q1", "median", "q3").withColumnRenamed("median", "median_fare")


@query
def demand_zone_hour(spark, sf):
    return analytics.demand_zone_hour(src.enriched(spark, sf))


@query
def demand_pivot(spark, sf):
    return analytics.demand_pivot(src.enriched(spark, sf))


@query
def pickup_heat_grid(spark, sf):
    return _rounded(grids.heat_grid(src.enriched(spark, sf)), 9, "weight")


@query
def pickup_kde_grid(spark, sf):
    return _rounded(grids.kde_grid(src.enriched(spark, sf)), 6, "density")


@query
def top_od_routes(spark, sf):
    return analytics.top_routes(src.enriched(spark, sf))


# Scalar functions


@query
def haversine_km(spark, sf):
    km = geo.haversine_km(F.col("origin_lat"), F.col("origin_lng"), F.col("dest_lat"), F.col("dest_lng"))
    return src.trips(spark, sf).select("trip_id", km.alias("distance_km"))


@query
def time_parts(spark, sf):
    ts = F.col("request_time")
    return src.trips(spark, sf).select(
        "trip_id", times.hour_of_day(ts).alias("hour_of_day"), times.day_of_week(ts).alias("day_of_week")
    )


@query
def label_log1p(spark, sf):
    return _rounded(ft.labelled(src.enriched(spark, sf)).select("trip_id", "label"), 9, "label")


@query
def label_inverse(spark, sf):
    fare = fares.from_label(fares.to_label(F.col("actual_fare")))
    return src.enriched(spark, sf).select("trip_id", F.round(fare, 6).alias("fare"))


def _tariff():
    return fares.tariff(F.col("distance_km"), F.col("vehicle_type"), F.col("surge_multiplier"), F.col("weather"))


@query
def fare_round_500(spark, sf):
    return src.enriched(spark, sf).select("trip_id", fares.round_to(_tariff()).alias("fare"))


@query
def tariff_fare(spark, sf):
    return src.enriched(spark, sf).select("trip_id", F.round(_tariff(), 6).alias("tariff"))


@query
def tariff_residual_audit(spark, sf):
    audit = analytics.residual_audit(src.enriched(spark, sf), 0.10)
    return _rounded(audit, 4, "within_tolerance").withColumnRenamed("within_tolerance", "within_10pct")


@query
def in_service_area(spark, sf):
    return src.trips(spark, sf).select(
        "trip_id",
        geo.in_service_area(F.col("origin_lat"), F.col("origin_lng")).alias("origin_inside"),
        geo.in_service_area(F.col("dest_lat"), F.col("dest_lng")).alias("dest_inside"),
    )


@query
def model_version_label(spark, sf):
    version = times.model_version(F.col("created_at"))
    return src.trips(spark, sf).groupBy(version.alias("model_version")).agg(F.count(F.lit(1)).alias("n"))


@query
def sql_functions(spark, sf):
    geo.register_sql_functions(spark)
    return spark.sql(
        "SELECT trip_id, haversine_km(origin_lat, origin_lng, dest_lat, dest_lng) AS distance_km, "
        "zone_of(origin_lat, origin_lng) AS origin_zone, zone_of(dest_lat, dest_lng) AS dest_zone FROM {trips}",
        trips=src.trips(spark, sf),
    )


# Batch twins of the stream operators


@query
def dedupe_events(spark, sf):
    deliveries = F.array(*[F.struct(F.lit(i).alias("delivery"), driver.alias("driver_id")) for i, driver in (
        (1, F.col("driver_id")), (2, F.concat(F.lit("again-"), F.col("driver_id"))),
    )])
    sent = src.trips(spark, sf).select("trip_id", "request_time", F.inline(deliveries))
    return merge.first_per_key(sent, ["trip_id"], ["delivery"])


# Streams: events are sent in several deliveries, and every delivery is taken up where the last one ended


_JSON = {"ignoreNullFields": "false", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _deliver(rows: DataFrame, folder: str) -> None:
    """Add one delivery of JSON lines to a folder that a stream reads."""
    rows.select(F.to_json(F.struct(*TRIP_EVENT.fieldNames()), _JSON).alias("value")).write.mode("append").text(folder)


def _ended(stream: StreamingQuery) -> None:
    stream.awaitTermination()
    if stream.exception() is not None:
        raise stream.exception()


def _sent(spark: SparkSession, sf: str) -> DataFrame:
    return slices.align(src.trips(spark, sf), StructType([*TRIP_EVENT.fields, StructField("event_id", LongType(), True)]))


@query
def stream_landing(spark, sf):
    base = tables.run_path(shared_dir(spark), "landing")
    sent, third = _sent(spark, sf), F.col("event_id") % 3
    again = F.concat(F.lit("again-"), F.col("driver_id"))
    long = F.when(F.col("event_id") % 29 == 4, F.lit("x" * 21)).otherwise(F.col("weather"))

    def land(checkpoint: str) -> None:
        _ended(ingest(read_lines(spark, f"{base}/in"), f"{base}/raw", f"{base}/dead", f"{base}/{checkpoint}", clock=lambda: RUN_TS))

    # The second delivery repeats a third of the first, the last one all, and some events do not fit the table.
    for rows in (sent.filter(third != 2), sent.filter(third != 0).withColumn("driver_id", again), sent):
        _deliver(rows.withColumn("weather", long), f"{base}/in")
        land("checkpoint")
    land("checkpoint")
    land("lost")  # Without its checkpoint the stream begins anew and changes nothing that has landed.
    raw = tables.read_parquet(spark, f"{base}/raw", RAW_STORED)
    dead = spark.read.schema("value string, error string, batch_id long").parquet(f"{base}/dead")
    landed = raw.select("trip_id", "driver_id", "request_time", "created_at", "weather", F.lit(None).cast("string").alias("error"))
    failed = dead.select(F.get_json_object("value", "$.trip_id").alias("trip_id"), "error").distinct()
    return landed.unionByName(failed, allowMissingColumns=True)


@query
def stream_zone_stats(spark, sf):
    base = tables.run_path(shared_dir(spark), "live")
    trips = tables.stamped(slices.align(src.located(spark, sf).withColumn("part", F.col("event_id") % 3), _PARTED), "created_at")
    for part in range(3):  # Every delivery has trips of all days, so all but the first bring late ones.
        trips.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(RAW_STORED).parquet(f"{base}/in")
        _ended(keep_zone_stats(stream, f"{base}/stats", f"{base}/checkpoint", clock=lambda: RUN_TS))
    return tables.read_parquet(spark, f"{base}/stats", ZONE_DAILY_STATS).select(
        "stat_date", "zone", "trip_count", "avg_fare", "avg_distance_km", "avg_surge", "rain_trip_count"
    )


_PARTED = StructType([*RAW_TRIPS.fields, StructField("part", LongType(), True)])


@query
def stream_dedupe(spark, sf):
    base = tables.run_path(shared_dir(spark), "dedupe")
    sent, held_back = _sent(spark, sf), (F.col("event_id") % 5 == 0) & (F.col("request_time") >= times.zone_free(LAST_EVENTS))
    again = F.concat(F.lit("again-"), F.col("driver_id"))
    # Repeats of the last day are known, older ones are late, and what was held back of the last day is new.
    for rows in (sent.filter(~held_back), sent.withColumn("driver_id", F.when(held_back, F.col("driver_id")).otherwise(again))):
        _deliver(rows, f"{base}/in")
        good, _ = parse_events(read_lines(spark, f"{base}/in"))
        writer = dedupe(good).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
        _ended(writer.trigger(availableNow=True).start(f"{base}/out"))
    return tables.read_parquet(spark, f"{base}/out", TRIP_EVENT).select("trip_id", "driver_id", "request_time")


# Metric series


@query
def metric_increase_5m(spark, sf):
    log = src.latency_log(spark, sf).select("event_id", "label", "ts")
    return metrics.increase(log, dt.timedelta(minutes=5)).select(
        "event_id", "label", F.col("increase").alias("increase_5m")
    )


@query
def metric_counter_increase(spark, sf):
    samples = src.events(spark, sf).select("ts", F.col("event_type").alias("label"), "value")
    return _rounded(metrics.counter_increase(samples.filter(F.col("value").isNotNull())), 4, "increase")


@query
def metric_counter_increase_sliding(spark, sf):
    samples = src.events(spark, sf).select("ts", F.col("event_type").alias("label"), "value")
    return _rounded(metrics.counter_increase_sliding(samples, dt.timedelta(minutes=30)), 4, "increase")


@query
def request_rate_per_min(spark, sf):
    return metrics.rate_per_min(src.latency_log(spark, sf))


@query
def latency_histogram_quantile(spark, sf):
    p95 = metrics.histogram_quantile(src.latency_log(spark, sf), 0.95)
    return _rounded(p95, 6, "quantile").withColumnRenamed("quantile", "p95")


@query
def latency_quantiles_daily(spark, sf):
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return _rounded(metrics.histogram_quantiles(src.latency_log(spark, sf), probs, window="1 day"), 6, *probs)


@query
def latency_buckets(spark, sf):
    return metrics.buckets(src.latency_log(spark, sf))


@query
def requests_by_status(spark, sf):
    return metrics.by_status(src.latency_log(spark, sf))


@query
def metric_latest_threshold(spark, sf):
    return metrics.latest_level(src.latency_log(spark, sf))


# Machine learning


@query
def category_index(spark, sf):
    trips = src.enriched(spark, sf).select(*ft.CATEGORIES)
    values = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("label"), F.col(f"{c}_idx").cast("bigint").alias("idx"))
        for c in ft.CATEGORIES
    ])
    indexed = ft.indexer().fit(trips).transform(trips)
    return indexed.select(F.inline(values)).groupBy("feature", "label", "idx").agg(F.count(F.lit(1)).alias("n"))


@query
def category_index_many(spark, sf):
    trips = src.trips(spark, sf).select("trip_id", "driver_id")
    known = trips.filter(F.col("trip_id").like("%0"))
    return ft.indexed_by_rank(trips, "driver_id", ft.frequency_ranks(known, "driver_id"), "idx")


@query
def assemble_skip_invalid(spark, sf):
    trips = src.located(spark, sf).select("trip_id", *ft.NUMBERS, *ft.CATEGORIES)
    indexed = ft.indexer().fit(trips).transform(trips)
    return ft.assembler().transform(indexed).select("trip_id")


@query
def standardize_numeric(spark, sf):
    trips = src.enriched(spark, sf).select("trip_id", *ft.NUMBERS, *ft.CATEGORIES)
    scaled = ft.fit_features(trips).transform(trips)
    values, names = vector_to_array("features"), [*ft.NUMBERS, *ft.CATEGORIES]
    return scaled.select("trip_id", *[F.round(values[i], 6).alias(f"z_{name}") for i, name in enumerate(names)])


@query
def train_test_split(spark, sf):
    side = F.when(ft.is_training("trip_id"), F.lit("train")).otherwise(F.lit("test"))
    return src.enriched(spark, sf).select("trip_id", side.alias("side"))


def _fares(spark: SparkSession, sf: str) -> Warehouse:
    """A warehouse of the session's own with the trips of ``sf`` in it, in the shared folder."""
    wh = Warehouse(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/fares-{hashlib.sha256(sf.encode()).hexdigest()[:16]}")
    if not jobs.enriched_table(spark, wh).limit(1).count():
        trips = slices.align(src.enriched(spark, sf).withColumn("processed_at", F.col("created_at")), TRIPS_ENRICHED)
        jobs.insert_enriched(wh, tables.stamped(trips, "processed_at"))
    return wh


def _trained(spark: SparkSession, sf: str) -> tuple[str, PipelineModel, GBTRegressionModel]:
    """The registered model of the trips of ``sf``, read from its files; trained first if there is none."""
    wh = _fares(spark, sf)
    if jobs.load_latest(spark, wh) is None:
        jobs.train_fares(spark, wh, RUN_TS, max_iter=TRAIN_ITERATIONS)
    return jobs.load_latest(spark, wh)


def _plausible(fare: str = "predicted_fare") -> Column:
    """Whether a predicted fare is within a factor of three of the tariff, the rule behind the fares learned from.

    Of a model that has learned from a few hundred trips, two fares in a thousand are off by more than a factor of two.
    """
    return F.col(fare).between(_tariff() / 3, _tariff() * 3)


@query
def train_fare_model(spark, sf):
    wh = _fares(spark, sf)
    version = jobs.train_fares(spark, wh, RUN_TS, max_iter=TRAIN_ITERATIONS)
    registered, features, model = jobs.load_latest(spark, wh)
    logged = tables.read_parquet(spark, wh.metrics, MODEL_METRICS).filter(F.col("model_version") == version)
    entry = tables.read_parquet(spark, wh.registry, MODEL_REGISTRY).withColumnRenamed("created_at", "train_date")
    same = [F.col(f"m.{c}") == F.col(f"e.{c}") for c in ("model_version", "train_date", "rmse", "mae", "r2", "num_samples")]
    both = logged.alias("m").join(entry.alias("e"), functools.reduce(Column.__and__, same))
    return both.select(
        "m.model_version", "m.train_date", "m.num_samples", "m.notes",
        F.lit(registered).alias("registered"), F.lit(model.getNumTrees).alias("trees"),
        F.lit(model.numFeatures).alias("inputs"), F.lit(len(features.stages)).alias("feature_stages"),
        ((F.col("m.mae") > 0) & (F.col("m.mae") <= F.col("m.rmse"))).alias("errors_in_order"), (F.col("m.r2") > 0.8).alias("fits"),
    )


@query
def score_unscored(spark, sf):
    left = merge.unscored(src.enriched(spark, sf), src.predictions(spark, sf))
    scored = ml.score_trips(left, *_trained(spark, sf)[1:])
    return scored.withColumn("plausible", _plausible()).drop("predicted_fare")


@query
def score_requests(spark, sf):
    accepted, _ = slices.request_defaults(src.requests(spark, sf))
    version, features, model = _trained(spark, sf)
    scored = ml.score_requests(accepted, features, model, version, "trip_id")
    # A fare on its own says little; beside its request it can be judged.
    asked = accepted.select("trip_id", "vehicle_type", "surge_multiplier", "weather")
    rows = scored.join(asked, "trip_id").withColumn("fare", F.col("predicted_fare_idr").cast("double"))
    return rows.select(
        "trip_id", "model_version", "distance_km",
        (F.col("predicted_fare_idr") % 500 == 0).alias("whole_steps"),
        # The model has seen no trip of 0.3 km or less.
        F.when(F.col("distance_km") > 0.3, _plausible("fare")).otherwise(F.col("fare") > 0).alias("plausible"),
    )


@query
def feedback_merge(spark, sf):
    known = src.enriched(spark, sf).filter(F.col("created_at") < times.zone_free(dt.datetime(2024, 1, 15)))
    target = slices.align(known.withColumn("processed_at", F.col("created_at")), TRIPS_ENRICHED)
    return ml.feedback(src.predictions(spark, sf), target, RUN_TS)


@query
def latest_model_version(spark, sf):
    scored = src.predictions(spark, sf, "created_at")
    logged = ml.regression_metrics(scored, by={"model_version": times.model_version(F.col("created_at"))}, also=[F.max("created_at").alias("created_at")])
    registry = logged.withColumnsRenamed({"n": "num_samples"}).withColumn("path", F.concat(F.lit("models/"), F.col("model_version")))
    newest = ml.latest_model(slices.align(registry, MODEL_REGISTRY), 0.9)
    return _rounded(_rounded(newest, 4, "rmse", "mae"), 6, "r2")
