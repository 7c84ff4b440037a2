"""Row counts taken while a job writes, instead of by a second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def counted(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The table itself, and an observation whose ``get["rows"]`` is known once it was written."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def row_count(df: DataFrame) -> DataFrame:
    """Row count as a one-row table, for plans that go on without a driver action."""
    return df.agg(F.count(F.lit(1)).alias("n"))
