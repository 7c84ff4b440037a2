"""How much each query shuffles and reads, with broadcasts and adaptive execution off."""

import re

import pytest

from __spark_entry__ import queries
from ridelake.operators import quantiles

# Shuffles of distinct data; reused ones are not counted.
SHUFFLES = {
    "scan_parquet": 0, "enrich_trips": 0, "project_training_slice": 0, "day_slice": 0, "trailing_window": 0,
    "zone_assign_case": 0, "request_defaults": 0, "feedback_align": 0, "train_test_split": 0, "tariff_fare": 0,
    "global_count": 1, "zone_daily_stats": 1, "zone_stats_windowed": 1, "demand_pivot": 1, "demand_zone_hour": 1,
    "top_od_routes": 1, "regression_metrics": 1, "prediction_audit_bounds": 1, "check_unique_key": 1,
    "dedupe_events": 1, "tariff_residual_audit": 1, "request_rate_per_min": 1, "latency_histogram_quantile": 1,
    "latency_buckets": 1, "requests_by_status": 1, "metric_latest_threshold": 1, "model_version_label": 1,
    "pickup_kde_grid": 2, "unscored_trips": 2, "zone_assign_range_join": 1,
}

COLUMNS = {
    "global_count": set(),
    "requests_by_status": {"event_type"},
    "day_slice": {"event_id", "ts"},
    "enrich_trips": {"event_id", "ts"},
    "zone_daily_stats": {"event_id", "user_id"},
    "latency_histogram_quantile": {"ts", "event_type", "value"},
    "check_unique_key": {"l_orderkey", "l_linenumber"},
}


@pytest.fixture
def static(spark):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(static, sf, name):
    plan = physical(queries()[name](static, sf))
    assert len(re.findall(r"[-+] Exchange |^Exchange ", plan, re.M)) == SHUFFLES[name], plan


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_only_needed_columns_are_read(spark, sf, name):
    plan = physical(queries()[name](spark, sf))
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan) for c in s.split(",") if c}
    assert read == COLUMNS[name]


def test_shuffled_aggregates_combine_first(static, sf):
    plan = physical(queries()["zone_daily_stats"](static, sf))
    assert plan.index("partial_sum") > plan.index("Exchange hashpartitioning(origin_zone")


def test_rolling_increase_counts_once(static, sf):
    plan = physical(queries()["metric_increase_5m"](static, sf))
    assert plan.count("FileScan") == 2 and "ReusedExchange" in plan


def test_quantiles_order_one_range(static, sf, monkeypatch):
    plan = physical(queries()["median_fare_by_vehicle"](static, sf))
    assert plan.count("FileScan") == 1
    # Ranges narrowed to one value need no further look at the rows.
    monkeypatch.setattr(quantiles, "BOUNDED", 0)
    plan = physical(queries()["median_fare_by_vehicle"](static, sf))
    assert "FileScan" not in plan and "Window" not in plan
