"""The same queries as plain SQL over the base tables, for an independent engine."""

from __future__ import annotations

from ridelake.functions.geo import SERVICE_AREA, ZONE_BOXES
from ridelake.sources.trips import TRIP_COLUMNS


def _zone(point: str) -> str:
    tests = " ".join(
        f"WHEN {point}_lat BETWEEN {b.lat_min}e0 AND {b.lat_max}e0 AND {point}_lng BETWEEN {b.lng_min}e0 "
        f"AND {b.lng_max}e0 THEN '{b.zone}'"
        for b in ZONE_BOXES
    )
    return f"CASE WHEN {point}_lat IS NULL OR {point}_lng IS NULL THEN 'Unknown' {tests} ELSE 'Lainnya' END"


def _inside(point: str) -> str:
    a = SERVICE_AREA
    return (
        f"coalesce({point}_lat BETWEEN {a.lat_min}e0 AND {a.lat_max}e0 "
        f"AND {point}_lng BETWEEN {a.lng_min}e0 AND {a.lng_max}e0, false)"
    )


HAVERSINE = (
    "CASE WHEN origin_lat IS NULL OR origin_lng IS NULL OR dest_lat IS NULL OR dest_lng IS NULL THEN NULL "
    "ELSE round(12742e0 * asin(sqrt(least(1e0, pow(sin(radians(dest_lat - origin_lat) / 2), 2) + "
    "cos(radians(origin_lat)) * cos(radians(dest_lat)) * pow(sin(radians(dest_lng - origin_lng) / 2), 2)))), 4) END"
)
TARIFF = (
    "(CASE vehicle_type WHEN 'motor' THEN 5000e0 + 2500e0 * distance_km WHEN 'car' THEN 10000e0 + 4000e0 * distance_km "
    "ELSE 25000e0 + 8000e0 * distance_km END) * surge_multiplier * "
    "(CASE weather WHEN 'rain' THEN 1.15e0 WHEN 'heavy_rain' THEN 1.3e0 ELSE 1e0 END)"
)
TRIPS = "trips AS (SELECT event_id, " + ", ".join(f"{sql} AS {name}" for name, sql in TRIP_COLUMNS.items()) + " FROM events)"
LOCATED = (
    "located AS (SELECT e.*, CASE WHEN event_id % 101 = 7 THEN NULL WHEN event_id % 103 = 11 THEN 0e0 "
    f"ELSE round_even({TARIFF} * (90 + event_id % 21) / 100e0 / 500e0, 0) * 500e0 END AS actual_fare FROM ("
    f"SELECT t.*, {HAVERSINE} AS distance_km, {_zone('origin')} AS origin_zone, {_zone('dest')} AS dest_zone, "
    "CAST(hour(request_time) AS INTEGER) AS hour_of_day, CAST(dayofweek(request_time) + 1 AS INTEGER) AS day_of_week "
    "FROM trips t) e)"
)
ENRICHED = "enriched AS (SELECT * FROM located WHERE distance_km > 0.3e0)"
SCORED_COLUMNS = (
    "trip_id, origin_lat, origin_lng, dest_lat, dest_lng, distance_km, vehicle_type, surge_multiplier, weather, "
    "hour_of_day, day_of_week, origin_zone"
)
PREDICTIONS = (
    f"predictions AS (SELECT {SCORED_COLUMNS}, actual_fare * (70 + event_id % 61) / 100e0 AS predicted_fare, "
    "actual_fare FROM enriched WHERE event_id % 7 <> 0)"
)
ZONES = "zones AS (SELECT * FROM (VALUES {}) AS z(zone, lat_min, lat_max, lng_min, lng_max, priority))".format(
    ", ".join(
        f"('{b.zone}', {b.lat_min}e0, {b.lat_max}e0, {b.lng_min}e0, {b.lng_max}e0, {i})"
        for i, b in enumerate(ZONE_BOXES)
    )
)
REQUESTS = (
    "requests AS (SELECT trip_id, origin_lat, origin_lng, dest_lat, dest_lng, distance_km, vehicle_type, "
    "nullif(surge_multiplier, 1e0) AS surge_multiplier, weather, hour_of_day, day_of_week, "
    "nullif(origin_zone, 'Lainnya') AS origin_zone, nullif(dest_zone, 'Lainnya') AS dest_zone FROM located)"
)
VALID = "predicted_fare > 0 AND actual_fare > 0 AND abs(predicted_fare - actual_fare) / actual_fare <= 0.20e0"


def _mean(x: str) -> str:
    """Mean at four digits of values that are not negative, by whole numbers, halves up."""
    units = f"sum(CAST(round({x} * 1e4) AS HUGEINT))"
    return f"CAST((2 * {units} + count({x})) // nullif(2 * count({x}), 0) AS DOUBLE) / 1e4"


MEASURES = (
    f"count(trip_id) AS trip_count, {_mean('actual_fare')} AS avg_fare, "
    f"{_mean('distance_km')} AS avg_distance_km, {_mean('surge_multiplier')} AS avg_surge, "
    "CAST(coalesce(sum(CASE WHEN weather IN ('rain', 'heavy_rain') THEN 1 ELSE 0 END), 0) AS BIGINT) AS rain_trip_count"
)
FEEDBACK = (
    "SELECT trip_id, CAST(NULL AS VARCHAR) AS driver_id, CAST(NULL AS VARCHAR) AS passenger_id, origin_lat, origin_lng, "
    "dest_lat, dest_lng, CAST(NULL AS TIMESTAMP) AS request_time, hour_of_day, day_of_week, distance_km, origin_zone, "
    "CAST(NULL AS VARCHAR) AS dest_zone, vehicle_type, surge_multiplier, weather, actual_fare, "
    f"TIMESTAMP '2024-01-31 00:00:00' AS processed_at FROM predictions WHERE {VALID}"
)
BOUNDS = (
    "(VALUES (0.01e0, 1, 0e0), (0.05e0, 2, 0.01e0), (0.1e0, 3, 0.05e0), (0.25e0, 4, 0.1e0), (0.5e0, 5, 0.25e0), "
    "(1e0, 6, 0.5e0), (2e0, 7, 1e0), (5e0, 8, 2e0)) AS h(le, ord, lag_le)"
)
HASH = "CAST('0x' || substr(md5(trip_id), 1, 8) AS BIGINT)"
R2 = (
    "coalesce(1 - sum(pow(predicted_fare - actual_fare, 2)) / nullif(var_pop(actual_fare) * count(*), 0e0), 0e0)"
)
BY_DAY = "SELECT CAST(created_at AS DATE) AS stat_date, origin_zone AS zone, " + MEASURES + " FROM enriched GROUP BY 1, 2"

# What each derived table needs before it.
_CTES = {
    "trips": [TRIPS],
    "located": [TRIPS, LOCATED],
    "enriched": [TRIPS, LOCATED, ENRICHED],
    "predictions": [TRIPS, LOCATED, ENRICHED, PREDICTIONS],
    "requests": [TRIPS, LOCATED, REQUESTS],
    "zones": [TRIPS, ZONES],
}


def _on(name: str, sql: str, *more: str) -> str:
    return "WITH " + ", ".join([*_CTES[name], *more]) + " " + sql


# The model's inputs.
INDEXED = ("vehicle_type", "weather", "origin_zone", "dest_zone")
STANDARDIZED = (
    "distance_km", "surge_multiplier", "hour_of_day", "day_of_week", "origin_lat", "origin_lng", "dest_lat", "dest_lng",
)


def _indexes() -> list[str]:
    return [
        f"index_{c} AS (SELECT {c}, count(*) AS n, "
        f"row_number() OVER (ORDER BY {c} IS NULL, count(*) DESC, {c}) - 1 AS idx FROM enriched GROUP BY {c})"
        for c in INDEXED
    ]


ORACLE: dict[str, str] = {
    "scan_parquet": "SELECT event_id, user_id, event_type, value FROM events",
    "scan_project_limit": _on(
        "enriched",
        "SELECT trip_id, origin_lat, origin_lng, dest_lat, dest_lng, origin_zone, dest_zone, vehicle_type, actual_fare, "
        "distance_km, surge_multiplier, weather, hour_of_day, day_of_week FROM enriched "
        f"ORDER BY {HASH}, trip_id LIMIT 50000",
    ),
    "raw_zone_copy": _on(
        "enriched", "SELECT trip_id, distance_km, origin_zone, CAST(created_at AS DATE) AS dt FROM enriched"
    ),
    "decode_events": (
        "WITH v AS (SELECT *, event_id % 13 = 5 AS cut, event_id % 17 = 3 AS other FROM events) "
        "SELECT CASE WHEN cut THEN left(props, length(props) - 1) WHEN other THEN replace(props, '\"k\"', '\"j\"') ELSE props END AS value, "
        "CASE WHEN cut THEN 'not a trip event' WHEN other THEN 'no k' END AS error, "
        "CASE WHEN NOT cut AND NOT other THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM v"
    ),
    "merge_insert_if_absent": _on(
        "enriched",
        "SELECT * FROM target UNION ALL SELECT d.trip_id, d.actual_fare FROM d "
        "WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.trip_id = d.trip_id)",
        "target AS (SELECT trip_id, actual_fare FROM enriched WHERE created_at < TIMESTAMP '2024-01-16 00:00:00')",
        "batch AS (SELECT trip_id, actual_fare, 1 AS delivery FROM enriched WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00' "
        "UNION ALL SELECT trip_id, actual_fare + 500e0, 2 FROM enriched WHERE created_at >= TIMESTAMP '2024-01-11 00:00:00')",
        "d AS (SELECT trip_id, actual_fare FROM "
        "(SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY delivery) AS rn FROM batch) x WHERE rn = 1)",
    ),
    "merge_upsert": _on(
        "enriched",
        "SELECT * FROM batch UNION ALL SELECT t.* FROM target t "
        "WHERE NOT EXISTS (SELECT 1 FROM batch b WHERE b.stat_date = t.stat_date AND b.zone = t.zone)",
        "s AS (SELECT CAST(created_at AS DATE) AS stat_date, origin_zone AS zone, count(trip_id) AS trip_count, "
        f"{_mean('actual_fare')} AS avg_fare FROM enriched GROUP BY 1, 2)",
        "target AS (SELECT stat_date, zone, trip_count - 1 AS trip_count, avg_fare FROM s WHERE stat_date < DATE '2024-01-20')",
        "batch AS (SELECT * FROM s WHERE stat_date >= DATE '2024-01-15')",
    ),
    "keyed_table_merge": _on(
        "enriched",
        "SELECT trip_id, CASE WHEN created_at < TIMESTAMP '2024-01-16 00:00:00' THEN actual_fare ELSE actual_fare + 500e0 END "
        "AS actual_fare FROM enriched",
    ),
    "daily_load": _on(
        "enriched",
        "SELECT CAST(created_at AS DATE) AS stat_date, origin_zone AS zone, count(trip_id) AS trip_count, "
        f"{_mean('actual_fare')} AS avg_fare, count(*) AS stored, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS inserted_again "
        "FROM raw_fares WHERE created_at >= TIMESTAMP '2024-01-15 00:00:00' AND created_at < TIMESTAMP '2024-01-17 00:00:00' GROUP BY 1, 2",
        "raw_fares AS (SELECT * FROM enriched)",
    ),
    "stream_landing": _on(
        "trips",
        "SELECT trip_id, CASE WHEN event_id % 3 = 2 THEN 'again-' || driver_id ELSE driver_id END AS driver_id, request_time, "
        "TIMESTAMP '2024-01-31 00:00:00' AS created_at, weather, CAST(NULL AS VARCHAR) AS error FROM trips WHERE event_id % 29 <> 4 "
        "UNION ALL SELECT trip_id, NULL, NULL, NULL, NULL, 'weather too long' FROM trips WHERE event_id % 29 = 4",
    ),
    "stream_zone_stats": _on("enriched", BY_DAY),
    "stream_dedupe": _on("trips", "SELECT trip_id, driver_id, request_time FROM trips"),
    "sql_functions": _on(
        "trips", f"SELECT trip_id, {HAVERSINE} AS distance_km, {_zone('origin')} AS origin_zone, {_zone('dest')} AS dest_zone FROM trips"
    ),
    "train_fare_model": _on(
        "enriched",
        "SELECT 'gbt_fare_20240131' AS model_version, TIMESTAMP '2024-01-31 00:00:00' AS train_date, count(*) AS num_samples, "
        "'GBT Regressor' AS notes, 'gbt_fare_20240131' AS registered, 100 AS trees, 12 AS inputs, 3 AS feature_stages, "
        f"true AS errors_in_order, true AS fits FROM enriched WHERE actual_fare > 0 AND {HASH} % 100 >= 80",
    ),
    "score_unscored": _on(
        "predictions",
        f"SELECT {', '.join('e.' + c.strip() for c in SCORED_COLUMNS.split(','))}, e.actual_fare, true AS plausible FROM enriched e "
        "WHERE NOT EXISTS (SELECT 1 FROM predictions p WHERE p.trip_id = e.trip_id)",
    ),
    "score_requests": _on(
        "requests",
        "SELECT trip_id, 'gbt_fare_20240131' AS model_version, distance_km, true AS whole_steps, true AS plausible FROM requests "
        "WHERE origin_lat IS NOT NULL AND origin_lng IS NOT NULL AND dest_lat IS NOT NULL AND dest_lng IS NOT NULL "
        "AND distance_km IS NOT NULL AND vehicle_type IS NOT NULL AND hour_of_day IS NOT NULL AND day_of_week BETWEEN 1 AND 7",
    ),
    "category_index_many": _on(
        "trips",
        "SELECT trip_id, t.driver_id, coalesce(idx, (SELECT count(*) FROM ranks)) AS idx FROM trips t LEFT JOIN ranks r ON t.driver_id = r.driver_id",
        "ranks AS (SELECT driver_id, row_number() OVER (ORDER BY count(*) DESC, driver_id) - 1 AS idx FROM trips "
        "WHERE trip_id LIKE '%0' GROUP BY driver_id)",
    ),
    "check_unique_key": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "project_training_slice": _on(
        "enriched",
        "SELECT trip_id, origin_lat, origin_lng, dest_lat, dest_lng, distance_km, vehicle_type, surge_multiplier, weather, "
        "hour_of_day, day_of_week, origin_zone, dest_zone, actual_fare FROM enriched "
        "WHERE actual_fare IS NOT NULL AND actual_fare > 0",
    ),
    "enrich_trips": _on(
        "enriched", "SELECT trip_id, distance_km, origin_zone, dest_zone, hour_of_day, day_of_week FROM enriched"
    ),
    "filter_min_distance": _on("located", "SELECT trip_id, distance_km FROM located WHERE distance_km > 0.3e0"),
    "dropna_coordinates": _on(
        "trips",
        "SELECT trip_id, origin_lat, origin_lng, dest_lat, dest_lng FROM trips WHERE origin_lat IS NOT NULL "
        "AND origin_lng IS NOT NULL AND dest_lat IS NOT NULL AND dest_lng IS NOT NULL",
    ),
    "filter_label_valid": _on("enriched", "SELECT trip_id, actual_fare FROM enriched WHERE actual_fare > 0"),
    "feedback_valid_predictions": _on(
        "predictions", f"SELECT trip_id, predicted_fare, actual_fare FROM predictions WHERE {VALID}"
    ),
    "feedback_align": _on("predictions", FEEDBACK),
    "day_slice": _on("trips", "SELECT trip_id, created_at FROM trips WHERE CAST(created_at AS DATE) = DATE '2024-01-15'"),
    "trailing_window": _on(
        "trips", "SELECT trip_id, created_at FROM trips WHERE created_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAYS"
    ),
    "request_defaults": _on(
        "requests",
        "SELECT trip_id, CASE WHEN ok THEN coalesce(surge_multiplier, 1e0) ELSE surge_multiplier END AS surge_multiplier, "
        "CASE WHEN ok THEN coalesce(weather, 'sunny') ELSE weather END AS weather, "
        "CASE WHEN ok THEN coalesce(origin_zone, 'Jakarta Pusat') ELSE origin_zone END AS origin_zone, "
        "CASE WHEN ok THEN coalesce(dest_zone, 'Jakarta Pusat') ELSE dest_zone END AS dest_zone, ok AS accepted "
        "FROM (SELECT *, origin_lat IS NOT NULL AND origin_lng IS NOT NULL AND dest_lat IS NOT NULL AND dest_lng IS NOT NULL "
        "AND distance_km IS NOT NULL AND vehicle_type IS NOT NULL AND hour_of_day IS NOT NULL "
        "AND coalesce(day_of_week BETWEEN 1 AND 7, false) AS ok FROM requests) r",
    ),
    "prediction_audit": _on(
        "predictions",
        "SELECT trip_id, actual_fare, predicted_fare, origin_zone FROM predictions WHERE actual_fare IS NOT NULL "
        f"ORDER BY {HASH}, trip_id LIMIT 5000",
    ),
    "prediction_audit_bounds": _on(
        "predictions",
        "SELECT greatest(max(actual_fare), max(predicted_fare)) AS max_fare, count(*) AS n FROM predictions "
        "WHERE actual_fare IS NOT NULL",
    ),
    "unscored_trips": _on(
        "predictions",
        "SELECT trip_id, request_time, e.actual_fare FROM enriched e LEFT JOIN predictions p USING (trip_id) "
        "WHERE p.trip_id IS NULL",
    ),
    "unscored_trips_capped": _on(
        "predictions",
        "SELECT trip_id, request_time FROM enriched e LEFT JOIN predictions p USING (trip_id) WHERE p.trip_id IS NULL "
        "ORDER BY request_time, trip_id LIMIT 1000",
    ),
    "zone_assign_case": _on(
        "trips", f"SELECT trip_id, {_zone('origin')} AS origin_zone, {_zone('dest')} AS dest_zone FROM trips"
    ),
    "zone_assign_range_join": _on(
        "zones",
        "SELECT t.trip_id, coalesce(min_by(z.zone, z.priority), CASE WHEN t.origin_lat IS NULL OR t.origin_lng IS NULL "
        "THEN 'Unknown' ELSE 'Lainnya' END) AS origin_zone FROM trips t LEFT JOIN zones z "
        "ON t.origin_lat BETWEEN z.lat_min AND z.lat_max AND t.origin_lng BETWEEN z.lng_min AND z.lng_max "
        "GROUP BY t.trip_id, t.origin_lat, t.origin_lng",
    ),
    "zone_daily_stats": _on(
        "enriched", f"SELECT DATE '2024-01-15' AS stat_date, origin_zone AS zone, {MEASURES} FROM enriched GROUP BY origin_zone"
    ),
    "zone_stats_windowed": _on("enriched", BY_DAY),
    "latest_zone_stats": _on("enriched", f"SELECT * FROM ({BY_DAY}) s ORDER BY stat_date DESC, zone LIMIT 50"),
    "global_count": _on("trips", "SELECT count(*) AS n FROM trips"),
    "regression_metrics": _on(
        "predictions",
        "SELECT count(*) AS n, round(sqrt(avg(pow(predicted_fare - actual_fare, 2))), 4) AS rmse, "
        f"round(avg(abs(predicted_fare - actual_fare)), 4) AS mae, round({R2}, 6) AS r2 "
        "FROM predictions WHERE actual_fare IS NOT NULL",
    ),
    "median_fare_by_vehicle": _on(
        "enriched",
        "SELECT vehicle_type, round(median(actual_fare), 4) AS median_actual_fare FROM enriched "
        "WHERE actual_fare IS NOT NULL GROUP BY vehicle_type",
    ),
    "boxplot_fare_by_vehicle": _on(
        "enriched",
        "SELECT q.vehicle_type, round(q1, 4) AS q1, round(q2, 4) AS median_fare, round(q3, 4) AS q3, "
        "min(CASE WHEN actual_fare >= q1 - 1.5e0 * (q3 - q1) THEN actual_fare END) AS whisker_low, "
        "max(CASE WHEN actual_fare <= q3 + 1.5e0 * (q3 - q1) THEN actual_fare END) AS whisker_high, "
        "CAST(sum(CASE WHEN actual_fare < q1 - 1.5e0 * (q3 - q1) OR actual_fare > q3 + 1.5e0 * (q3 - q1) THEN 1 ELSE 0 END) "
        "AS BIGINT) AS outliers FROM enriched e JOIN q ON e.vehicle_type = q.vehicle_type WHERE actual_fare IS NOT NULL "
        "GROUP BY q.vehicle_type, q1, q2, q3",
        "q AS (SELECT vehicle_type, quantile_cont(actual_fare, 0.25) AS q1, median(actual_fare) AS q2, "
        "quantile_cont(actual_fare, 0.75) AS q3 FROM enriched WHERE actual_fare IS NOT NULL GROUP BY vehicle_type)",
    ),
    "demand_zone_hour": _on(
        "enriched",
        "SELECT origin_zone, hour_of_day, count(*) AS trips FROM enriched WHERE origin_zone IS NOT NULL "
        "AND hour_of_day IS NOT NULL GROUP BY 1, 2",
    ),
    "demand_pivot": _on(
        "enriched",
        "SELECT origin_zone, "
        + ", ".join(f"count(*) FILTER (WHERE hour_of_day = {h}) AS h{h:02d}" for h in range(24))
        + " FROM enriched GROUP BY origin_zone",
    ),
    "pickup_heat_grid": _on(
        "enriched",
        "SELECT *, round(trips / CAST((SELECT max(trips) FROM g) AS DOUBLE), 9) AS weight FROM g",
        "g AS (SELECT CAST(floor(origin_lat / 0.01e0) AS BIGINT) AS cell_lat, CAST(floor(origin_lng / 0.01e0) AS BIGINT) "
        "AS cell_lng, count(*) AS trips FROM enriched GROUP BY 1, 2)",
    ),
    "pickup_kde_grid": _on(
        "enriched",
        "SELECT g.y + oy.d AS cell_lat, g.x + ox.d AS cell_lng, "
        "round(sum(n * exp(-(oy.d * oy.d + ox.d * ox.d) / 2e0)), 6) AS density "
        "FROM g CROSS JOIN o oy CROSS JOIN o ox GROUP BY 1, 2",
        "g AS (SELECT CAST(floor(origin_lat / 0.01e0) AS BIGINT) AS y, CAST(floor(origin_lng / 0.01e0) AS BIGINT) AS x, "
        "count(*) AS n FROM enriched GROUP BY 1, 2)",
        "o AS (SELECT * FROM (VALUES (-2), (-1), (0), (1), (2)) AS a(d))",
    ),
    "top_od_routes": _on(
        "enriched",
        "SELECT concat_ws(' → ', origin_zone, dest_zone) AS route, count(*) AS trips FROM enriched "
        "GROUP BY origin_zone, dest_zone ORDER BY count(*) DESC, origin_zone, dest_zone LIMIT 10",
    ),
    "haversine_km": _on("trips", f"SELECT trip_id, {HAVERSINE} AS distance_km FROM trips"),
    "time_parts": _on(
        "trips",
        "SELECT trip_id, CAST(hour(request_time) AS INTEGER) AS hour_of_day, "
        "CAST(dayofweek(request_time) + 1 AS INTEGER) AS day_of_week FROM trips",
    ),
    "label_log1p": _on("enriched", "SELECT trip_id, round(ln(1 + actual_fare), 9) AS label FROM enriched"),
    "label_inverse": _on("enriched", "SELECT trip_id, round(exp(ln(1 + actual_fare)) - 1, 6) AS fare FROM enriched"),
    "fare_round_500": _on("enriched", f"SELECT trip_id, round_even({TARIFF} / 500e0, 0) * 500e0 AS fare FROM enriched"),
    "tariff_fare": _on("enriched", f"SELECT trip_id, round({TARIFF}, 6) AS tariff FROM enriched"),
    "tariff_residual_audit": _on(
        "enriched",
        "SELECT vehicle_type, count(*) AS n, round(avg(CASE WHEN abs(actual_fare - tariff) <= 0.1e0 * tariff THEN 1e0 "
        f"ELSE 0e0 END), 4) AS within_10pct FROM (SELECT *, {TARIFF} AS tariff FROM enriched WHERE actual_fare > 0) x GROUP BY 1",
    ),
    "in_service_area": _on(
        "trips", f"SELECT trip_id, {_inside('origin')} AS origin_inside, {_inside('dest')} AS dest_inside FROM trips"
    ),
    "model_version_label": _on(
        "trips", "SELECT 'gbt_fare_' || strftime(created_at, '%Y%m%d') AS model_version, count(*) AS n FROM trips GROUP BY 1"
    ),
    "dedupe_events": _on(
        "trips",
        "SELECT trip_id, driver_id, request_time, delivery FROM (SELECT *, row_number() OVER "
        "(PARTITION BY trip_id ORDER BY delivery) AS rn FROM sent) x WHERE rn = 1",
        "sent AS (SELECT trip_id, driver_id, request_time, 1 AS delivery FROM trips UNION ALL "
        "SELECT trip_id, 'again-' || driver_id, request_time, 2 FROM trips)",
    ),
    "metric_increase_5m": (
        "SELECT event_id, event_type AS label, count(*) OVER (PARTITION BY event_type ORDER BY ts "
        "RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS increase_5m FROM events"
    ),
    "metric_counter_increase": (
        "WITH s AS (SELECT event_type AS label, ts, max(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1, 2), "
        "p AS (SELECT *, lag(value) OVER (PARTITION BY label ORDER BY ts) AS previous FROM s) "
        "SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS window_start, label, "
        "round(coalesce(sum(CASE WHEN value < previous THEN value ELSE value - previous END), 0e0), 4) AS increase "
        "FROM p GROUP BY 1, 2"
    ),
    "metric_counter_increase_sliding": (
        "WITH s AS (SELECT event_type AS label, ts, max(value) AS value FROM events WHERE value IS NOT NULL "
        "AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2), "
        "p AS (SELECT *, lag(value) OVER (PARTITION BY label ORDER BY ts) AS previous FROM s), "
        "g AS (SELECT label, ts, coalesce(CASE WHEN value < previous THEN value ELSE value - previous END, 0e0) AS grown FROM p) "
        "SELECT label, ts, round(sum(grown) OVER (PARTITION BY label ORDER BY ts "
        "RANGE BETWEEN INTERVAL 30 MINUTES PRECEDING AND CURRENT ROW), 4) AS increase FROM g"
    ),
    "request_rate_per_min": (
        "SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS minute_start, event_type AS status, count(*) AS per_minute "
        "FROM events GROUP BY 1, 2"
    ),
    "latency_histogram_quantile": (
        "WITH m AS (SELECT time_bucket(INTERVAL 5 MINUTES, ts) AS win, event_type AS label, value / 100e0 AS v FROM events "
        "WHERE value IS NOT NULL), b AS (SELECT win, label, le, ord, lag_le, sum(CASE WHEN v <= le THEN 1 ELSE 0 END) AS cum, "
        f"count(*) AS n FROM m CROSS JOIN {BOUNDS} GROUP BY win, label, le, ord, lag_le), "
        "c AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY win, label ORDER BY ord), 0) AS prev FROM b), "
        "r AS (SELECT win, label, n, min(CASE WHEN cum >= 0.95e0 * n THEN ord END) AS k FROM c GROUP BY win, label, n) "
        "SELECT r.win AS window_start, r.label AS label, r.n AS n, round(CASE WHEN r.k IS NULL THEN 5e0 "
        "ELSE c.lag_le + (c.le - c.lag_le) * (0.95e0 * r.n - c.prev) / nullif(c.cum - c.prev, 0) END, 6) AS p95 "
        "FROM r LEFT JOIN c ON c.win = r.win AND c.label = r.label AND c.ord = r.k"
    ),
    "latency_quantiles_daily": (
        "WITH m AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS win, event_type AS label, value / 100e0 AS v FROM events "
        "WHERE value IS NOT NULL), b AS (SELECT win, label, le, ord, lag_le, sum(CASE WHEN v <= le THEN 1 ELSE 0 END) AS cum, "
        f"count(*) AS n FROM m CROSS JOIN {BOUNDS} GROUP BY win, label, le, ord, lag_le), "
        "c AS (SELECT *, coalesce(lag(cum) OVER (PARTITION BY win, label ORDER BY ord), 0) AS prev FROM b), "
        "q AS (SELECT * FROM (VALUES (0.5e0), (0.95e0), (0.99e0)) AS t(q)), "
        "r AS (SELECT win, label, n, q, min(CASE WHEN cum >= q * n THEN ord END) AS k FROM c CROSS JOIN q GROUP BY win, label, n, q), "
        "e AS (SELECT r.win, r.label, r.n, r.q, round(CASE WHEN r.k IS NULL THEN 5e0 "
        "ELSE c.lag_le + (c.le - c.lag_le) * (r.q * r.n - c.prev) / nullif(c.cum - c.prev, 0) END, 6) AS x "
        "FROM r LEFT JOIN c ON c.win = r.win AND c.label = r.label AND c.ord = r.k) "
        "SELECT win AS window_start, label, n, max(CASE WHEN q = 0.5e0 THEN x END) AS p50, "
        "max(CASE WHEN q = 0.95e0 THEN x END) AS p95, max(CASE WHEN q = 0.99e0 THEN x END) AS p99 FROM e GROUP BY win, label, n"
    ),
    "latency_buckets": (
        "SELECT event_type AS label, count(value) AS n, le, "
        "CAST(coalesce(sum(CASE WHEN value / 100e0 <= le THEN 1 ELSE 0 END), 0) AS BIGINT) AS cumulative "
        f"FROM events CROSS JOIN {BOUNDS} GROUP BY event_type, le"
    ),
    "requests_by_status": "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1",
    "metric_latest_threshold": (
        "SELECT event_type AS label, max_by(value, row(ts, value)) / 100e0 AS last_value, "
        "CASE WHEN max_by(value, row(ts, value)) / 100e0 >= 1e0 THEN 'red' WHEN max_by(value, row(ts, value)) / 100e0 >= 0.5e0 THEN 'yellow' "
        "ELSE 'green' END AS level FROM events WHERE value IS NOT NULL GROUP BY 1"
    ),
    "category_index": _on(
        "enriched",
        " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS label, n, idx FROM index_{c}" for c in INDEXED),
        *_indexes(),
    ),
    "assemble_skip_invalid": _on(
        "located",
        "SELECT trip_id FROM located WHERE distance_km IS NOT NULL AND surge_multiplier IS NOT NULL AND hour_of_day IS NOT NULL "
        "AND day_of_week IS NOT NULL AND origin_lat IS NOT NULL AND origin_lng IS NOT NULL AND dest_lat IS NOT NULL "
        "AND dest_lng IS NOT NULL",
    ),
    "standardize_numeric": _on(
        "enriched",
        "SELECT trip_id, " + ", ".join(
            f"round(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER (), 6) + 0e0 AS z_{name}"
            for x, name in [(f"e.{c}", c) for c in STANDARDIZED] + [(f"index_{c}.idx", c) for c in INDEXED]
        ) + " FROM enriched e " + " ".join(f"JOIN index_{c} ON index_{c}.{c} IS NOT DISTINCT FROM e.{c}" for c in INDEXED),
        *_indexes(),
    ),
    "train_test_split": _on(
        "enriched", f"SELECT trip_id, CASE WHEN {HASH} % 100 < 80 THEN 'train' ELSE 'test' END AS side FROM enriched"
    ),
    "feedback_merge": _on(
        "predictions",
        "SELECT * FROM target UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.trip_id = f.trip_id)",
        "target AS (SELECT trip_id, driver_id, passenger_id, origin_lat, origin_lng, dest_lat, dest_lng, request_time, "
        "hour_of_day, day_of_week, distance_km, origin_zone, dest_zone, vehicle_type, surge_multiplier, weather, actual_fare, "
        "created_at AS processed_at FROM enriched WHERE created_at < TIMESTAMP '2024-01-15 00:00:00')",
        f"fresh AS ({FEEDBACK})",
    ),
    "latest_model_version": _on(
        "predictions",
        "SELECT model_version, path, created_at, round(rmse, 4) AS rmse, round(mae, 4) AS mae, round(r2, 6) AS r2, num_samples "
        "FROM registry WHERE r2 >= 0.9e0 ORDER BY created_at DESC LIMIT 1",
        "registry AS (SELECT 'gbt_fare_' || strftime(created_at, '%Y%m%d') AS model_version, "
        "'models/gbt_fare_' || strftime(created_at, '%Y%m%d') AS path, max(created_at) AS created_at, "
        "sqrt(avg(pow(predicted_fare - p.actual_fare, 2))) AS rmse, avg(abs(predicted_fare - p.actual_fare)) AS mae, "
        "coalesce(1 - sum(pow(predicted_fare - p.actual_fare, 2)) / nullif(var_pop(p.actual_fare) * count(*), 0e0), 0e0) AS r2, "
        "count(*) AS num_samples FROM predictions p JOIN trips t USING (trip_id) "
        "WHERE p.actual_fare IS NOT NULL GROUP BY 1, 2)",
    ),
}
