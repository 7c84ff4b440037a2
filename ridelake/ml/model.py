"""Training, evaluation, scoring, feedback and the model registry."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.fares import from_label, round_to
from ridelake.operators.merge import insert_if_absent
from ridelake.operators.slices import align, moment, valid_predictions
from ridelake.schemas import DEFAULT_NOW, TRIP_PREDICTIONS, TRIPS_ENRICHED
from ridelake.session import ensure_checkpoint_dir

SCORED_COLUMNS = [name for name in TRIP_PREDICTIONS.fieldNames() if name != DEFAULT_NOW["trip_predictions"]]


#: Rows of one training partition, at most and at least.
MOST_ROWS, LEAST_ROWS = 1_000_000, 10_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The rows in equal parts, as many as the cores or a multiple of it, sorted by their unique ``key``.

    Boosting passes hundreds of times over its partitions, and each pass
    shuffles from all to all, so parts cut by bytes cost the square of the
    input; parts of unequal size leave cores idle. The order lets a lost part
    be made again as it was, because boosting pairs it with its residuals.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(cores * -(-rows // (cores * MOST_ROWS)), -(-rows // LEAST_ROWS))
    return df.repartition(max(1, parts), key).sortWithinPartitions(key)


def train(
    df: DataFrame,
    max_iter: int = 100,
    max_depth: int = 5,
    step: float = 0.1,
    subsample: float = 0.8,
    seed: int = 42,
) -> GBTRegressionModel:
    """Boosted trees on ``features`` and ``label``.

    Boosting caches its input and grows a lineage per tree; the checkpoint
    folder lets it cut that lineage, so a lost executor costs little.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return GBTRegressor(
        featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
        stepSize=step, subsamplingRate=subsample, seed=seed, checkpointInterval=10,
    ).fit(df.select("features", "label"))


def save(features: PipelineModel, model: GBTRegressionModel, path: str) -> None:
    """Write both artifacts of a training run below ``path``, in place of an earlier try of the same run."""
    features.write().overwrite().save(f"{path}/features")
    model.write().overwrite().save(f"{path}/model")


def load(path: str) -> tuple[PipelineModel, GBTRegressionModel]:
    return PipelineModel.load(f"{path}/features"), GBTRegressionModel.load(f"{path}/model")


def regression_metrics(
    df: DataFrame,
    predicted: str = "predicted_fare",
    actual: str = "actual_fare",
    by: Mapping[str, Column] | None = None,
    also: Sequence[Column] = (),
) -> DataFrame:
    """n, rmse, mae and r2 in one pass; r2 is 0 when the actual values do not vary.

    An empty table yields n = 0 and null errors. With ``by`` there is a row for
    each group; ``also`` are further aggregates.
    """
    gap = F.col(predicted) - F.col(actual)
    n = F.count(F.lit(1))
    total = F.nullif(F.var_pop(actual) * n, F.lit(0.0))
    rows = df.filter(F.col(actual).isNotNull()).groupBy(*[c.alias(name) for name, c in (by or {}).items()])
    return rows.agg(
        n.alias("n"),
        F.sqrt(F.avg(F.pow(gap, F.lit(2.0)))).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.coalesce(F.lit(1.0) - F.sum(F.pow(gap, F.lit(2.0))) / total, F.lit(0.0)).alias("r2"),
        *also,
    )


def evaluate(test: DataFrame, model: GBTRegressionModel, version: str, run_ts: dt.datetime) -> DataFrame:
    """One metrics row for the log, computed in currency."""
    scored = model.transform(test).select(
        from_label(F.col("prediction")).alias("predicted_fare"), from_label(F.col("label")).alias("actual_fare")
    )
    return regression_metrics(scored).select(
        F.lit(version).alias("model_version"),
        moment(run_ts).alias("train_date"),
        "rmse",
        "mae",
        "r2",
        F.col("n").alias("num_samples"),
        F.lit("GBT Regressor").alias("notes"),
    )


def predict(df: DataFrame, features: PipelineModel, model: GBTRegressionModel) -> DataFrame:
    """All input columns and ``predicted_fare``; rows the assembler cannot use are left out."""
    scored = model.transform(features.transform(df)).withColumn("predicted_fare", from_label(F.col("prediction")))
    return scored.select(*[c for c in df.columns if c != "predicted_fare"], "predicted_fare")


def score_trips(unscored: DataFrame, features: PipelineModel, model: GBTRegressionModel) -> DataFrame:
    return predict(unscored, features, model).select(*SCORED_COLUMNS)


def score_requests(
    accepted: DataFrame, features: PipelineModel, model: GBTRegressionModel, version: str, key: str | None = None
) -> DataFrame:
    """Fare in steps of 500 for every accepted request, with its distance and the model version."""
    return predict(accepted, features, model).select(
        *([key] if key else []),
        round_to(F.col("predicted_fare")).cast("bigint").alias("predicted_fare_idr"),
        F.lit(version).alias("model_version"),
        "distance_km",
    )


def feedback_rows(predictions: DataFrame, run_ts: dt.datetime, tol: float = 0.20) -> DataFrame:
    """Well-predicted trips in the shape of the enriched table; unknown columns are null."""
    return align(
        valid_predictions(predictions, tol).withColumn("processed_at", moment(run_ts)), TRIPS_ENRICHED
    )


def feedback(predictions: DataFrame, target: DataFrame, run_ts: dt.datetime, tol: float = 0.20) -> DataFrame:
    """``target`` with the well-predicted trips it lacks."""
    return insert_if_absent(target, feedback_rows(predictions, run_ts, tol), ["trip_id"])


def training_weight(predictions: DataFrame, tol: float = 0.20, weight: float = 2.0) -> DataFrame:
    """Opt-in: trips confirmed by a good prediction, with a weight for the next training."""
    return valid_predictions(predictions, tol).select("trip_id", F.lit(weight).alias("training_weight"))


def latest_model(registry: DataFrame, min_r2: float | None = None) -> DataFrame:
    """Newest registered model, among the good ones if a lowest r2 is given."""
    good = registry if min_r2 is None else registry.filter(F.col("r2") >= min_r2)
    row = F.struct("created_at", *[c for c in registry.columns if c != "created_at"])
    return (
        good.agg(F.max(row).alias("m"))
        .filter(F.col("m").isNotNull())
        .select(*[F.col(f"m.{c}").alias(c) for c in registry.columns])
    )
