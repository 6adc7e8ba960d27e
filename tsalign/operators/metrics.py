"""Regression metrics, per-batch means, error tables and run histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.functions.scalar import relative_error
from tsalign.operators.windows import pearson


def regression_metrics(
    df: DataFrame, by: Sequence[str] = (), prediction: str = "prediction", target: str = "target"
) -> DataFrame:
    """MSE, MAE, RMSE, R² (0 for a constant target), r (0 when undefined), error moments and ranges."""
    p, t = F.col(prediction), F.col(target)
    error = p - t
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.coalesce(1 - F.try_divide(F.sum(error * error), F.var_pop(t) * F.count(t)), F.lit(0.0)).alias("r2"),
        pearson(p, t).alias("correlation"),
        F.avg(error).alias("error_mean"),
        F.stddev_samp(error).alias("error_std"),
        F.min(p).alias("prediction_min"),
        F.max(p).alias("prediction_max"),
        F.min(t).alias("target_min"),
        F.max(t).alias("target_max"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def batch_mean_metrics(
    df: DataFrame,
    batch: str,
    by: Sequence[str] = (),
    prediction: str = "prediction",
    target: str = "target",
    size: int | None = None,
) -> DataFrame:
    """Mean of the per-batch means; with ``size`` batches shorter than that are left out."""
    error = F.col(prediction) - F.col(target)
    per_batch = df.groupBy(*by, batch).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(error * error).alias("_mse"), F.avg(F.abs(error)).alias("_mae")
    )
    if size is not None:
        per_batch = per_batch.where(F.col("_n") >= size)
    aggs = [
        F.count(F.lit(1)).alias("batches"),
        F.avg("_mse").alias("mse_batch_mean"),
        F.avg("_mae").alias("mae_batch_mean"),
        F.sqrt(F.avg("_mse")).alias("rmse_batch_mean"),
    ]
    return per_batch.groupBy(*by).agg(*aggs) if by else per_batch.agg(*aggs)


def error_table(
    df: DataFrame, idx: str, prediction: str = "prediction", target: str = "target", n: int | None = None
) -> DataFrame:
    """Index, truth, prediction, error and relative error; all rows, or the first ``n`` by index."""
    p, t = F.col(prediction), F.col(target)
    out = df.select(
        F.col(idx).alias("idx"),
        t.alias("target"),
        p.alias("prediction"),
        (p - t).alias("error"),
        relative_error(p, t).alias("relative_error"),
    )
    return out if n is None else out.orderBy("idx").limit(n)


def best_epoch(history: DataFrame, by: Sequence[str] = ("run",), epoch: str = "epoch", loss: str = "val_mse") -> DataFrame:
    """First epoch with the strictly lowest loss."""
    best = F.min(F.struct(F.col(loss).alias("loss"), F.col(epoch).alias("epoch")))
    return (
        history.where(F.col(loss).isNotNull())
        .groupBy(*by)
        .agg(best.alias("_best"))
        .select(*by, F.col("_best.epoch").alias("best_epoch"), F.col("_best.loss").alias("best_loss"))
    )
