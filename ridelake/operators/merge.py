"""Keyed merges on plain tables: insert-if-absent and upsert.

All functions are lazy. Rows with a null key part are dropped: a keyed table
cannot hold them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _keys_present(keys: Sequence[str]) -> Column:
    present = F.lit(True)
    for key in keys:
        present = present & F.col(key).isNotNull()
    return present


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    # An aggregate rather than a ranking window: copies of a key collapse on
    # the map side, so a key repeated very often never reaches one task whole.
    leading = [c for c in order if c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in leading]
    if not leading and not rest:
        return df.filter(_keys_present(keys)).distinct()
    picked = (
        df.filter(_keys_present(keys)).groupBy(*keys).agg(pick(F.struct(*leading, *rest)).alias("_row"))
    )
    return picked.select(
        *[F.col(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row of every key by ``order``; remaining columns break ties."""
    return _one_per_key(df, keys, order, F.min)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The last row of every key by ``order``; remaining columns break ties."""
    return _one_per_key(df, keys, order, F.max)


def new_rows(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order: Sequence[str] = (),
    broadcast_keys: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Rows of ``batch``, one per key, whose key ``target`` does not hold.

    The target is first cut down to the keys the batch mentions. That step may
    broadcast the batch's keys, so a small batch never shuffles a large target;
    an anti join alone could only broadcast the target. Spark decides by the
    size it estimates; ``broadcast_keys`` is for callers that counted the batch.
    ``buckets`` is for a target stored in so many buckets of its key: one row per
    key of the batch is dealt out alike, and the target is joined as it lies.
    """
    keys = list(keys)
    chosen = first_per_key(batch, keys, order)
    if buckets is None:
        mentioned = batch.filter(_keys_present(keys)).select(*keys).distinct()
    else:
        chosen = chosen.repartition(buckets, *keys)
        mentioned = chosen.select(*keys)
    if broadcast_keys:
        mentioned = F.broadcast(mentioned)
    held = target.select(*keys).join(mentioned, keys, "left_semi")
    return chosen.join(held, keys, "left_anti").select(*batch.columns)


def insert_if_absent(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()
) -> DataFrame:
    """``target`` with the new keys of ``batch`` added; held keys stay as they are."""
    return target.unionByName(new_rows(target, batch, keys, order).select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``target`` with rows of ``batch`` replacing or joining it; the last batch row of a key wins."""
    keys = list(keys)
    latest = last_per_key(batch, keys, order)
    kept = target.join(latest.select(*keys), keys, "left_anti").select(*target.columns)
    return kept.unionByName(latest.select(*target.columns))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held more than once, with their row count; empty for a proper key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key repeats. Runs a job; reads back a single row at most."""
    found = duplicate_keys(df, keys).limit(1).collect()
    if found:
        raise ValueError(f"key {list(keys)} is not unique, for example {found[0].asDict()}")


def unscored(trips: DataFrame, predictions: DataFrame, unscorable: DataFrame | None = None) -> DataFrame:
    """Trips without a prediction and, if given, not known to be unscorable."""
    left = trips.join(predictions.select("trip_id"), "trip_id", "left_anti")
    if unscorable is not None:
        left = left.join(unscorable.select("trip_id"), "trip_id", "left_anti")
    return left
