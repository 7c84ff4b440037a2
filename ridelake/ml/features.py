"""Feature pipeline of the fare model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.fares import to_label
from ridelake.operators.firstn import hash_rank
from ridelake.session import ensure_checkpoint_dir

# The model's inputs.
CATEGORIES = ["vehicle_type", "weather", "origin_zone", "dest_zone"]
NUMBERS = [
    "distance_km", "surge_multiplier", "hour_of_day", "day_of_week",
    "origin_lat", "origin_lng", "dest_lat", "dest_lng",
]


def indexer(columns: Sequence[str] = CATEGORIES) -> StringIndexer:
    """Most frequent value first; unseen and missing values share one extra index.

    One stage for all columns counts them in a single pass.
    """
    return StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep"
    )


#: Ranks that may be broadcast to the rows.
BROADCAST_RANKS = 500_000


def frequency_ranks(df: DataFrame, column: str) -> DataFrame:
    """(label, n, idx): values by falling frequency and then by themselves, numbered from 0, like ``indexer``.

    For columns of very many values, which ``indexer`` would gather on the
    driver. The values are sorted by range and numbered within each range; one
    row per range says how many come before it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("label")]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}).checkpoint()
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.min("seq").alias("first"))
    before = F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    shifts = sizes.select("part", (before - F.col("first")).alias("shift"))
    return ranged.join(F.broadcast(shifts), "part").select("label", "n", (F.col("seq") + F.col("shift")).alias("idx"))


def indexed_by_rank(df: DataFrame, column: str, ranks: DataFrame, out: str) -> DataFrame:
    """Add ``out``, the rank of the value; unseen and missing values share the number after the last."""
    known = ranks.select(F.col("label").alias("_label"), F.col("idx").alias(out))
    size = known.count()
    known = F.broadcast(known) if size <= BROADCAST_RANKS else known
    rows = df.join(known, df[column] == F.col("_label"), "left").drop("_label")
    return rows.withColumn(out, F.coalesce(out, F.lit(size).cast("bigint")))


def assembler(categories: Sequence[str] = CATEGORIES, numbers: Sequence[str] = NUMBERS) -> VectorAssembler:
    """Rows with a missing number are left out."""
    return VectorAssembler(
        inputCols=[*numbers, *[f"{c}_idx" for c in categories]], outputCol="features_raw", handleInvalid="skip"
    )


def feature_pipeline(categories: Sequence[str] = CATEGORIES, numbers: Sequence[str] = NUMBERS) -> Pipeline:
    scaler = StandardScaler(inputCol="features_raw", outputCol="features", withMean=True, withStd=True)
    return Pipeline(stages=[indexer(categories), assembler(categories, numbers), scaler])


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("label", to_label(F.col("actual_fare")))


def is_training(key: str = "trip_id", pct: int = 80):
    """Membership of the training side: about ``pct`` percent of the keys, the same on any cluster."""
    return hash_rank(key) % F.lit(100) < F.lit(pct)


def hash_split(df: DataFrame, key: str = "trip_id", pct: int = 80) -> tuple[DataFrame, DataFrame]:
    inside = is_training(key, pct)
    return df.filter(inside), df.filter(~inside)


def fit_features(trips: DataFrame, fit_on: str = "all") -> PipelineModel:
    """Fit indexes and scaling on all rows, or with ``fit_on="train"`` on the training side only."""
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    return feature_pipeline().fit(trips if fit_on == "all" else hash_split(trips)[0])


def _missing(df: DataFrame) -> Column:
    missing = F.lit(False)
    kinds = dict(df.dtypes)
    for c in NUMBERS:
        missing = missing | F.col(c).isNull()
        if kinds[c] in ("double", "float"):
            missing = missing | F.isnan(c)
    return missing


def unscorable(df: DataFrame) -> DataFrame:
    """Trips the assembler would leave out: some number is null or NaN."""
    return df.filter(_missing(df))


def scorable(df: DataFrame) -> DataFrame:
    """The other trips."""
    return df.filter(~_missing(df))
