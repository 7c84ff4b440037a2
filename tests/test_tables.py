import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelake.schemas import ZONE_DAILY_STATS
from ridelake.sources import tables

SCHEMA = "k string, v int, dt date"
D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))


def frame(spark, *rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_at(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).select("k", "v", "dt").collect())


def test_only_touched_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.overwrite_partitions(frame(spark, ("a", 1, D1), ("b", 2, D2)), path, "dt") == 2
    assert tables.overwrite_partitions(frame(spark, ("c", 3, D2)), path, "dt") == 1
    assert rows_at(spark, path) == [("a", 1, D1), ("c", 3, D2)]
    assert tables.overwrite(frame(spark, ("z", 9, D1)), path + "x") == 1


def test_copy_zone(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    tables.overwrite_partitions(frame(spark, ("a", 1, D1), ("b", 2, D2)), a, "dt")
    copy = tables.copy_zone(spark, a, b, frame(spark).schema)
    assert copy.count() == 2 and rows_at(spark, b) == rows_at(spark, a)


def test_a_small_batch_reads_the_row_groups_of_its_keys(spark, tmp_path):
    path, schema = str(tmp_path / "t"), StructType(frame(spark).schema.fields[:2])
    rows = spark.range(0, 400_000, 1, 40).select(F.concat(F.lit("k"), F.col("id") * 7919 % 400_000).alias("k"), F.col("id").cast("int").alias("v"))
    assert tables.append(rows, path, keys=["k"]) == 400_000  # 40 files
    read = spark.read.schema(schema).parquet(path)
    # Every file's smallest and largest key enclose most of those asked for; its filter rules most files out.
    asked = [f"k{i}" for i in (0, 123_456, 399_999)] + [f"new{i}" for i in range(200)]
    batch = spark.createDataFrame([(k, -1) for k in asked], schema)
    assert tables.merge_absent(batch, path, schema, ["k"]) == 200
    scan = read.filter(F.col("k").isin(asked))
    assert len(scan.collect()) == 3
    plan = scan._jdf.queryExecution().executedPlan()
    assert "In(k, [" in plan.toString()
    assert plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 50_000
    assert tables.merge_absent(batch, path, schema, ["k"]) == 0
    assert spark.read.schema(schema).parquet(path).count() == 400_200


@pytest.mark.parametrize("lookup", [0, tables.LOOKUP_KEYS])
@pytest.mark.parametrize("limit", [0, tables.BROADCAST_KEYS])
@pytest.mark.parametrize("among", [None, "dt >= DATE'2024-01-01'"])
def test_merge_absent(spark, tmp_path, monkeypatch, lookup, limit, among):
    monkeypatch.setattr(tables, "LOOKUP_KEYS", lookup)
    monkeypatch.setattr(tables, "BROADCAST_KEYS", limit)
    path, schema = str(tmp_path / "t"), frame(spark).schema
    first = frame(spark, ("a", 1, D1), ("b", 2, D2), ("b", 3, D2))
    again = frame(spark, ("b", 9, D2), ("c", 4, D2), (None, 5, D2))
    args = (path, schema, ["k"], ["v"], ["dt"], among and F.expr(among))
    assert tables.merge_absent(first, *args) == 2
    assert tables.merge_absent(again, *args) == 1
    assert tables.merge_absent(again, *args) == 0
    assert rows_at(spark, path) == [("a", 1, D1), ("b", 2, D2), ("c", 4, D2)]


def test_merge_upsert_rewrites_only_its_days(spark, tmp_path):
    path = str(tmp_path / "t")
    now = dt.datetime(2024, 1, 9)

    def stats(*rows):
        return spark.createDataFrame([(d, z, n, 1.0, 1.0, 1.0, 0, now) for d, z, n in rows], ZONE_DAILY_STATS)

    key = ["stat_date", "zone"]
    tables.merge_upsert(stats((D1, "A", 1), (D2, "A", 2), (D2, "B", 3)), path, ZONE_DAILY_STATS, key, "stat_date")
    before = sorted(p.name for p in (tmp_path / "t" / "stat_date=2024-01-01").iterdir())
    tables.merge_upsert(stats((D2, "A", 20), (D3, "A", 30)), path, ZONE_DAILY_STATS, key, "stat_date")
    got = spark.read.schema(ZONE_DAILY_STATS).parquet(path)
    assert sorted((r.stat_date, r.zone, r.trip_count) for r in got.collect()) == [
        (D1, "A", 1), (D2, "A", 20), (D2, "B", 3), (D3, "A", 30),
    ]
    assert before == sorted(p.name for p in (tmp_path / "t" / "stat_date=2024-01-01").iterdir())
    with pytest.raises(ValueError):
        tables.merge_upsert(got, path, ZONE_DAILY_STATS, ["zone"], "stat_date")


def test_merge_absent_looks_only_where_told(spark, tmp_path):
    path, schema = str(tmp_path / "t"), frame(spark).schema
    tables.merge_absent(frame(spark, ("a", 1, D1), ("b", 2, D2)), path, schema, ["k"], by=["dt"])
    args = (path, schema, ["k"], (), ["dt"], F.col("dt") == F.lit(D2))
    assert tables.merge_absent(frame(spark, ("a", 9, D2), ("b", 9, D2)), *args) == 1


def test_staged_copy_is_dropped(spark):
    with tables.staged(spark.range(5).toDF("n"), "t") as copy:
        path = copy.inputFiles()[0].rsplit("/", 1)[0]
        assert copy.count() == 5
    assert not tables.drop(spark, path)
    assert tables.table_or_empty(spark, path, copy.schema).count() == 0


def test_runs_never_share_a_path():
    assert tables.run_path("/x/", "staging") != tables.run_path("/x", "staging")


def test_keys_of_a_large_batch_are_not_shuffled_to_be_counted(spark, monkeypatch):
    monkeypatch.setattr(tables, "LOOKUP_KEYS", 10)
    many, few = spark.range(5_000).select(F.col("id").alias("k")), spark.range(5_000).select((F.col("id") % 7).alias("k"))
    frames = type(many)
    shuffled, distinct = [], frames.distinct
    monkeypatch.setattr(frames, "distinct", lambda df: shuffled.append(df) or distinct(df))
    assert tables._few_keys(many, "k") == 5_000 and not shuffled
    assert sorted(r[0] for r in tables._few_keys(few, "k")) == list(range(7))
    assert tables._few_keys(many.filter("k < 15"), "k") == 15
