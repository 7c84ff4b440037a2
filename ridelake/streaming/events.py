"""Trip events as a stream: reading, decoding and removing repeats."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ridelake.schemas import MAX_LENGTH, TRIP_EVENT

TOPIC = "trip_events"
CORRUPT = "_corrupt"
#: Where a record stood in its source; sorts by arrival.
ARRIVAL = "arrival"


def kafka_options(
    brokers: str, topic: str = TOPIC, starting: str = "earliest", max_per_batch: int | None = None
) -> dict[str, str]:
    """Options of the Kafka source. The checkpoint, not a consumer group, keeps the position."""
    options = {"kafka.bootstrap.servers": brokers, "subscribe": topic, "startingOffsets": starting}
    if max_per_batch is not None:
        options["maxOffsetsPerTrigger"] = str(max_per_batch)
    return options


def read_kafka(spark: SparkSession, brokers: str, **options) -> DataFrame:
    """The topic as ``value``, text, and its ``arrival``; needs the Kafka connector on the class path."""
    source = spark.readStream.format("kafka").options(**kafka_options(brokers, **options)).load()
    return source.select(
        F.col("value").cast("string").alias("value"), F.struct("timestamp", "partition", "offset").alias(ARRIVAL)
    )


def read_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """JSON lines from the files of a folder as they arrive: ``value`` and its ``arrival``, by file and block."""
    reader = spark.readStream.format("text")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    place = [F.col(f"_metadata.{c}").alias(c) for c in ("file_modification_time", "file_name", "file_block_start")]
    return reader.load(path).select("value", F.struct(*place).alias(ARRIVAL))


def _problem(event: Column, schema: StructType, key: str) -> Column:
    """Why a record cannot be stored, or null.

    Every stored field must be there, though all but the key may be null, and
    no text may be longer than its column.
    """
    # The names are read from the text again, so only of records that a missing field has left a null in.
    some_null = functools.reduce(Column.__or__, [event[f.name].isNull() for f in schema])
    absent = F.array_except(F.array(*[F.lit(f.name) for f in schema]), F.json_object_keys("value"))
    problem = (
        F.when(event.isNull() | event[CORRUPT].isNotNull(), F.lit("not a trip event"))
        .when(event[key].isNull(), F.lit(f"no {key}"))
        .when(some_null & (F.size(absent) > 0), F.concat(F.lit("no "), F.array_join(absent, ", ")))
    )
    for field in schema:
        if field.name in MAX_LENGTH:
            problem = problem.when(F.length(event[field.name]) > MAX_LENGTH[field.name], F.lit(f"{field.name} too long"))
    return problem.otherwise(F.lit(None).cast("string"))


def decode(raw: DataFrame, schema: StructType = TRIP_EVENT, key: str = "trip_id") -> DataFrame:
    """Add the event's fields and ``error``: null, or why the record cannot be stored.

    Fields outside ``schema`` (the sender's own zones and time parts) are dropped;
    a column ``arrival`` stays.
    """
    wide = StructType([*schema.fields, StructField(CORRUPT, StringType(), True)])
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    event = F.col("_event")
    return raw.withColumn("_event", parsed).select(
        "value",
        _problem(event, schema, key).alias("error"),
        *[event[f.name].alias(f.name) for f in schema],
        *[c for c in raw.columns if c == ARRIVAL],
    )


def parse_events(raw: DataFrame, schema: StructType = TRIP_EVENT, key: str = "trip_id") -> tuple[DataFrame, DataFrame]:
    """Split a ``value`` column into storable events and (value, error) rows for the dead-letter table."""
    decoded = decode(raw, schema, key)
    good = decoded.filter(F.col("error").isNull()).select(*schema.fieldNames())
    return good, decoded.filter(F.col("error").isNotNull()).select("value", "error")


def dedupe(df: DataFrame, key: str = "trip_id", ts: str = "request_time", delay: str = "1 day") -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of it in event time.

    The watermark bounds what is remembered. Events that come later than it are
    dropped, so this is for live views; the landing table takes every event and
    compares ids itself. The watermark needs a zoned time, so the column is
    converted for it.
    """
    return (
        df.withColumn("_event_time", F.col(ts).cast("timestamp"))
        .withWatermark("_event_time", delay)
        .dropDuplicatesWithinWatermark([key])
        .drop("_event_time")
    )
