"""Relational database reads and writes through Spark's JDBC source."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# The driver class and rows per insert batch of the warehouse.
DRIVER = "org.postgresql.Driver"
WRITE_BATCH = 1000


def address(host: str, database: str, port: int = 5432) -> str:
    return f"jdbc:postgresql://{host}:{port}/{database}"


def credentials(user: str, password: str, driver: str = DRIVER) -> dict[str, str]:
    return {"user": user, "password": password, "driver": driver}


def read_options(
    url: str,
    table: str,
    properties: dict[str, str],
    partition_column: str | None = None,
    lower: Any = None,
    upper: Any = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> dict[str, str]:
    """Options of a scan; a subquery goes in ``table`` as ``(SELECT ...) AS t``.

    With a partition column the bounds only set the stride between tasks: rows
    outside them are still read, by the first and the last task.
    """
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if partition_column is not None:
        if lower is None or upper is None or partitions < 2:
            raise ValueError("a partitioned read needs bounds and at least two partitions")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower),
            "upperBound": str(upper),
            "numPartitions": str(partitions),
        }
    return options


def read_table(spark: SparkSession, **options: Any) -> DataFrame:
    return spark.read.format("jdbc").options(**read_options(**options)).load()


def write_options(url: str, table: str, properties: dict[str, str], batch: int = WRITE_BATCH) -> dict[str, str]:
    return {"url": url, "dbtable": table, "batchsize": str(batch), **properties}


def write_table(
    df: DataFrame, mode: str, url: str, table: str, properties: dict[str, str], batch: int = WRITE_BATCH
) -> None:
    df.write.format("jdbc").mode(mode).options(**write_options(url, table, properties, batch)).save()


def staging_name(table: str) -> str:
    """Staging table of one run; concurrent jobs must not overwrite each other's."""
    return f"{table}_{uuid.uuid4().hex[:12]}"
