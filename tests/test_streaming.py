import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ridelake.operators.enrich import enrich_trips
from ridelake.operators.slices import align
from ridelake.operators.stats import sums_by_day, zone_stats_by_day
from ridelake.plans import jobs
from ridelake.plans.warehouse import Warehouse
from ridelake.schemas import RAW_TRIPS, TRIP_EVENT, ZONE_DAILY_STATS
from ridelake.sources import tables
from ridelake.sources import trips as src
from ridelake.streaming import events, ingest

RUN = dt.datetime(2024, 2, 1)


@pytest.fixture(scope="module")
def event_lines(spark, sf):
    """Sent events as JSON text; the first forty of a stable order."""
    rows = align(src.located(spark, sf), TRIP_EVENT).orderBy("trip_id").limit(40)
    wide = rows.withColumns({"origin_zone": F.lit("sender's"), "hour_of_day": F.lit(99)})
    return [r[0] for r in wide.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def write(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


BAD = ["not json", '{"trip_id":"T9x","actual_fare":"abc"}', '{"driver_id":"D1"}', ""]


def test_parse_splits_good_from_bad(spark, event_lines):
    raw = spark.createDataFrame([(v,) for v in [*event_lines, *BAD, None]], "value string")
    good, bad = events.parse_events(raw)
    assert good.schema == TRIP_EVENT
    assert good.count() == len(event_lines)
    assert bad.count() == len(BAD) + 1
    errors = {r.value: r.error for r in bad.collect()}
    assert errors['{"driver_id":"D1"}'] == "no trip_id" and errors["not json"] == "not a trip event"
    first = good.orderBy("trip_id").first()
    sent = json.loads(event_lines[0])
    assert first.trip_id == sent["trip_id"] and first.request_time.isoformat()[:19] == sent["request_time"][:19]


def test_records_the_table_cannot_take(spark, event_lines):
    sent = json.loads(event_lines[0])
    cases = {
        "null fields are fine": (sent | {"weather": None, "actual_fare": None, "request_time": None}, None),
        "null key": (sent | {"trip_id": None}, "no trip_id"),
        "field left out": ({k: v for k, v in sent.items() if k not in ("weather", "dest_lat")}, "no dest_lat, weather"),
        "long text": (sent | {"weather": "x" * 21}, "weather too long"),
        "longest text": (sent | {"weather": "x" * 20}, None),
        "bad number": (sent | {"distance_km": "far"}, "not a trip event"),
    }
    raw = spark.createDataFrame([(json.dumps(v),) for v, _ in cases.values()], "value string")
    errors = {r.value: r.error for r in events.decode(raw).collect()}
    for name, (value, error) in cases.items():
        assert errors[json.dumps(value)] == error, name


def run(spark, tmp_path, **kwargs):
    raw = events.read_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    query = ingest.ingest(
        raw, str(tmp_path / "raw"), str(tmp_path / "dead"), str(tmp_path / "cp"), clock=lambda: RUN, **kwargs
    )
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "raw")), spark.read.parquet(str(tmp_path / "dead"))


@pytest.mark.parametrize("prune", [False, True])
def test_ingest_restart_repeats_and_dead_letters(spark, tmp_path, event_lines, prune):
    folder = tmp_path / "in"
    write(folder, "1.json", event_lines[:15] + BAD[:1])
    write(folder, "2.json", event_lines[10:25] + [event_lines[20]])
    raw, dead = run(spark, tmp_path, prune_by_day=prune)
    assert raw.count() == raw.select("trip_id").distinct().count() == 25
    assert {r.created_at for r in raw.collect()} == {RUN}
    write(folder, "3.json", event_lines + BAD[1:3])
    raw, dead = run(spark, tmp_path, prune_by_day=prune)
    assert raw.count() == raw.select("trip_id").distinct().count() == len(event_lines)
    assert dead.count() == 3 and set(dead.columns) == {"value", "error", "batch_id"}
    run(spark, tmp_path, prune_by_day=prune)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == len(event_lines)


def test_the_first_arrival_of_an_id_stays(spark, tmp_path, event_lines):
    first, second = ({**json.loads(line), "trip_id": "T-twice"} for line in event_lines[:2])
    sent = [json.dumps(first | {"driver_id": d}) for d in ("z", "a", "m")]
    write(tmp_path / "in", "1.json", [*event_lines[:5], *sent[:2], *event_lines[5:9], *BAD[:1]])
    raw, _ = run(spark, tmp_path)
    write(tmp_path / "in", "2.json", [sent[2], json.dumps(second | {"driver_id": "b"})])
    raw, _ = run(spark, tmp_path)
    assert [r.driver_id for r in raw.filter("trip_id = 'T-twice'").collect()] == ["z"]
    query = ingest.ingest(
        events.read_lines(spark, str(tmp_path / "in")), str(tmp_path / "raw2"), str(tmp_path / "dead2"), str(tmp_path / "cp2")
    )
    query.awaitTermination(120)
    again = spark.read.parquet(str(tmp_path / "raw2")).filter("trip_id = 'T-twice'")
    assert [r.driver_id for r in again.collect()] == ["z"]


def test_a_batch_run_again_changes_nothing(spark, tmp_path, event_lines):
    write(tmp_path / "in", "1.json", event_lines + BAD[:2])
    run(spark, tmp_path)
    # Losing the checkpoint replays everything under the same batch numbers.
    raw = events.read_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    query = ingest.ingest(raw, str(tmp_path / "raw"), str(tmp_path / "dead"), str(tmp_path / "cp2"), clock=lambda: RUN)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "raw")).count() == len(event_lines)
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2


def test_dedupe_within_watermark(spark, tmp_path, event_lines):
    write(tmp_path / "in", "1.json", event_lines)
    write(tmp_path / "in", "2.json", event_lines[::2])
    raw = events.read_lines(spark, str(tmp_path / "in"), files_per_batch=1)
    good, _ = events.parse_events(raw)
    out = events.dedupe(good)
    assert out.schema == TRIP_EVENT
    query = (
        out.writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert spark.table("deduped").count() == len(event_lines)


def test_live_and_daily_statistics_are_one_table(spark, sf, tmp_path):
    trips = tables.stamped(align(src.located(spark, sf), RAW_TRIPS), "created_at")
    wh = Warehouse(str(tmp_path / "wh"))
    landed = str(tmp_path / "in")
    for i in range(3):  # Every delivery has trips of all days, so all but the first bring late ones.
        trips.filter(F.crc32("trip_id") % 3 == i).coalesce(1).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(trips.schema).parquet(landed)
        query = ingest.keep_zone_stats(stream, str(tmp_path / "stats"), str(tmp_path / "cp"), clock=lambda: RUN)
        query.awaitTermination(240)
        assert query.exception() is None
    live = spark.read.schema(ZONE_DAILY_STATS).parquet(str(tmp_path / "stats"))
    tables.overwrite_partitions(trips, wh.raw_trips, "dt")
    days = sorted(r[0] for r in trips.select("dt").distinct().collect())
    for day in days[:3]:
        jobs.daily_etl(spark, wh, day, RUN)
    daily = spark.read.schema(ZONE_DAILY_STATS).parquet(wh.zone_daily_stats)
    some = live.filter(F.col("stat_date").isin(days[:3]))
    assert daily.count() == some.count() > 3 and daily.exceptAll(some).count() == 0
    want = zone_stats_by_day(enrich_trips(trips))
    assert live.select(*want.columns).exceptAll(want).count() == 0 and live.count() == want.count()


def test_a_batch_adds_its_sums_once(spark, sf):
    delta = sums_by_day(enrich_trips(align(src.located(spark, sf), RAW_TRIPS))).cache()
    none = delta.withColumn("batch_id", F.lit(0).cast("bigint")).limit(0)
    one = ingest.added(none, delta, 0)
    assert ingest.added(one, delta, 0).exceptAll(one).count() == 0
    # A run that was broken off has reached some zones only.
    half = ingest.added(one, delta.filter("zone < 'K'"), 1)
    two = ingest.added(half, delta, 1)
    assert two.exceptAll(ingest.added(one, delta, 1)).count() == 0
    assert two.agg(F.sum("trip_count")).first()[0] == 2 * delta.agg(F.sum("trip_count")).first()[0]
    delta.unpersist()


def test_requests_are_scored_as_a_stream(spark, sf, tmp_path):
    from ridelake.ml import features as ft
    from ridelake.ml import model as ml
    from ridelake.operators.slices import request_defaults, training_slice

    rows = ft.labelled(training_slice(src.enriched(spark, sf)))
    fitted = ft.fit_features(rows)
    model = ml.train(fitted.transform(rows), 2)
    requests = src.requests(spark, sf)
    requests.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accepted, _ = request_defaults(stream)
    query = (
        ml.score_requests(accepted, fitted, model, "v1", "trip_id").writeStream.format("memory").queryName("fares")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = ml.score_requests(request_defaults(requests)[0], fitted, model, "v1", "trip_id")
    got = spark.table("fares")
    assert got.count() == batch.count() > 900
    assert got.exceptAll(batch).count() == 0


def test_kafka_options():
    options = events.kafka_options("broker:9092", max_per_batch=1000)
    assert options == {
        "kafka.bootstrap.servers": "broker:9092", "subscribe": "trip_events", "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "1000",
    }


def test_texts_of_landed_events_are_not_kept(spark, tmp_path, event_lines, monkeypatch):
    write(tmp_path / "in", "1.json", event_lines[:10] + BAD[:2])
    kept, frames = [], type(spark.range(0))
    persist = frames.persist
    monkeypatch.setattr(frames, "persist", lambda df, level: kept.extend((r.error, r.value) for r in df.collect()) or persist(df, level))
    _, dead = run(spark, tmp_path)
    assert len(kept) == 12 and all((error is None) == (value is None) for error, value in kept)
    assert {r.value for r in dead.collect()} == set(BAD[:2])
