"""Parquet tables: scans, overwrites, dated partitions and table-level merges."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ridelake.operators.audit import counted
from ridelake.operators.merge import new_rows, upsert
from ridelake.session import shared_dir

# Keys of a batch that may be broadcast: a few tens of megabytes.
BROADCAST_KEYS = 500_000
# Values of a partition column that may be: centuries of days.
BROADCAST_VALUES = 100_000
# Keys of a batch that are looked up one by one, by the Bloom filters of a table's row groups.
LOOKUP_KEYS = 1_000


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Scan with a declared schema, so that no file is opened to infer one."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def overwrite(df: DataFrame, path: str) -> int:
    """Replace the table at ``path``; returns the rows written, counted in the same job."""
    df, seen = counted(df)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return seen.get["rows"]


def _few_files(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the rows of a partition together before they are written.

    A rebalance rather than a repartition: adaptive execution splits a large
    day over many tasks and puts small ones into one.
    """
    return df.hint("rebalance", *by) if by else df


def overwrite_partitions(df: DataFrame, path: str, by: str, few_files: bool = False) -> int:
    """Replace only the partitions of ``by`` that ``df`` has rows for.

    By default each task writes the partitions it meets, without a shuffle:
    right for rows of one day. ``few_files`` is for small batches over many.
    """
    df, seen = counted(_few_files(df, [by]) if few_files else df)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    return seen.get["rows"]


def _with_filters(writer: DataFrameWriter, keys: Sequence[str]) -> DataFrameWriter:
    """Let the files say for each row group which keys cannot be in it: three bytes a key, wrong once in 100,000 times."""
    for key in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.fpp#{key}", "0.00001")
    if keys:
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true").option("parquet.bloom.filter.max.bytes", str(8 << 20))
    return writer


def append(
    df: DataFrame, path: str, by: Sequence[str] = (), few_files: bool = False, keys: Sequence[str] = ()
) -> int:
    df, seen = counted(_few_files(df, by) if few_files else df)
    _with_filters(df.write.mode("append").partitionBy(*by), keys).parquet(path)
    return seen.get["rows"]


def stamped(df: DataFrame, ts: str, column: str = "dt") -> DataFrame:
    """Add the day a row belongs to, the partition column of dated tables."""
    return df.withColumn(column, F.col(ts).cast("date"))


def copy_zone(spark: SparkSession, source: str, dest: str, schema: StructType, by: str = "dt") -> DataFrame:
    """Copy a dated table into another zone and return the copy.

    The copy is what later steps read, so it also stands in for a cache.
    """
    overwrite_partitions(read_parquet(spark, source, schema), dest, by)
    return read_parquet(spark, dest, schema)


def run_path(base: str, name: str) -> str:
    """A path no other run uses; two jobs never share staging data."""
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The table at ``path``, or an empty one if nothing was written yet."""
    try:
        return read_parquet(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a table's files; False if there was nothing."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A written copy of ``df`` in the shared folder, dropped at the end of the block.

    What reads the copy does not depend on how ``df`` was derived, nor on the
    machines that derived it.
    """
    spark = df.sparkSession
    path = run_path(shared_dir(spark), f"staging-{name}")
    df.write.parquet(path)
    try:
        yield read_parquet(spark, path, df.schema)
    finally:
        drop(spark, path)


def _name_of(path: str, buckets: int) -> str:
    return f"keyed_{hashlib.sha256(path.encode()).hexdigest()[:20]}_{buckets}"


def keyed(
    spark: SparkSession, path: str, schema: StructType, key: str, buckets: int, by: Sequence[str] = ()
) -> DataFrame:
    """The table at ``path`` as one stored in ``buckets`` of ``key``, empty if nothing was written yet.

    Joins and merges on the key read it as it lies, without an exchange. Its
    files say which bucket they are; a session learns of the table when it first
    names it, so no catalog outlives the session. ``buckets`` is fixed for a path.
    """
    name = _name_of(path, buckets)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f"PARTITIONED BY ({', '.join(by)}) " if by else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet {parts}"
        f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    spark.catalog.refreshTable(name)
    return spark.table(name).select(*schema.fieldNames())


def append_keyed(df: DataFrame, path: str, schema: StructType, key: str, buckets: int, by: Sequence[str] = ()) -> int:
    """Append to the table ``keyed`` names; a bucket's rows are written by one task, in order of the key."""
    keyed(df.sparkSession, path, schema, key, buckets, by)
    df, seen = counted(df.select(*schema.fieldNames()).repartition(buckets, key))
    writer = _with_filters(df.write.mode("append").format("parquet").bucketBy(buckets, key).sortBy(key), [key])
    (writer.partitionBy(*by) if by else writer).saveAsTable(_name_of(path, buckets))
    return seen.get["rows"]


def _few_keys(batch: DataFrame, key: str) -> list[Row] | int:
    """The keys of a batch if they are few enough to be looked up, else the number of its rows.

    An estimate comes first, in the pass that counts, so that the keys of a
    large batch are not shuffled to learn that they are many.
    """
    seen = batch.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("keys")).first()
    if seen["keys"] > 2 * LOOKUP_KEYS:
        return seen["rows"]
    known = batch.select(key).distinct().limit(LOOKUP_KEYS + 1).collect()
    return known if len(known) <= LOOKUP_KEYS else seen["rows"]


def merge_absent(
    batch: DataFrame,
    path: str,
    schema: StructType,
    keys: Sequence[str],
    order: Sequence[str] = (),
    by: Sequence[str] = (),
    among: Column | None = None,
    few_files: bool = False,
    buckets: int | None = None,
) -> int:
    """Append the rows of ``batch`` whose key the table lacks; returns their number.

    ``among`` limits where a key is looked for, by a condition on the table's
    partition column; without it the keys of the whole table are compared.
    The keys of a very small batch are looked up: of the table only row groups
    are read whose filters do not rule them all out. The
    table is read, not shuffled, when a count finds the batch small, or
    however large the batch is if the table is stored in ``buckets`` of its
    one key.
    """
    spark = batch.sparkSession
    known = _few_keys(batch, keys[0]) if len(keys) == 1 else None
    lookup = isinstance(known, list)
    small = lookup or (batch.select(*keys).count() if known is None else known) <= BROADCAST_KEYS
    if buckets is None:
        target = table_or_empty(spark, path, schema)
    else:
        (key,) = keys
        target = keyed(spark, path, schema, key, buckets, by)
    if among is not None:
        target = target.filter(among)
    if lookup:
        # Longer lists would reach the scan as a range only.
        spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(LOOKUP_KEYS))
        target = target.filter(F.col(keys[0]).isin([r[0] for r in known if r[0] is not None]))
    fresh = new_rows(target, batch, keys, order, small, None if small else buckets).select(*schema.fieldNames())
    if buckets is None:
        return append(fresh, path, by, few_files, keys)
    return append_keyed(fresh, path, schema, key, buckets, by)


def replace_rows(batch: DataFrame, path: str, schema: StructType, keys: Sequence[str]) -> int:
    """Upsert into a small table without partitions, such as a log of runs; returns the rows it then has."""
    batch = batch.select(*schema.fieldNames())
    target = table_or_empty(batch.sparkSession, path, schema)
    with staged(upsert(target, batch, keys), "replace") as merged:
        return overwrite(merged, path)


def merge_upsert(
    batch: DataFrame, path: str, schema: StructType, keys: Sequence[str], by: str, order: Sequence[str] = ()
) -> int:
    """Upsert ``batch`` into the table partitioned by ``by``, rewriting only the partitions it touches.

    ``by`` must be one of the keys. The merged partitions are staged before
    they replace the files they were read from.
    """
    if by not in keys:
        raise ValueError("the partition column must be part of the key")
    target = table_or_empty(batch.sparkSession, path, schema).select(*schema.fieldNames())
    batch = batch.select(*schema.fieldNames())
    values = batch.select(by).distinct()
    # Few values are broadcast and let the scan skip the rest; more than that are shuffled.
    values = F.broadcast(values) if values.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES else values
    touched = target.join(values, by, "left_semi")
    with staged(upsert(touched, batch, keys, order), "upsert") as merged:
        return overwrite_partitions(merged, path, by, few_files=True)
