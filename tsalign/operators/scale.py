"""Feature scaling with statistics fitted on the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import join_keys
from tsalign.operators.durable import durable
from tsalign.operators.quantile import quantiles


def fit_standard(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column, one row (or one per ``by``); a zero deviation becomes 1."""
    aggs = []
    for c in cols:
        aggs += [
            F.avg(c).alias(f"{c}_center"),
            F.when(F.stddev_pop(c) == 0, F.lit(1.0)).otherwise(F.stddev_pop(c)).alias(f"{c}_scale"),
        ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def fit_robust(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and interquartile range per column; a zero range becomes 1."""
    q = quantiles(df, by, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    aggs = []
    for c in cols:
        mine = F.col("feature") == c
        aggs += [
            F.max(F.when(mine, F.col("median"))).alias(f"{c}_center"),
            F.max(F.when(mine, F.when(spread == 0, F.lit(1.0)).otherwise(spread))).alias(f"{c}_scale"),
        ]
    return q.groupBy(*by).agg(*aggs) if by else q.agg(*aggs)


def scaled(x: Column, center: Column, scale: Column) -> Column:
    return (x - center) / scale


def apply_scaler(
    df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = (), suffix: str = "_scaled"
) -> DataFrame:
    """``(x - center) / scale`` for every column.

    One-row statistics enter as a scalar subquery, so the data is neither
    shuffled nor joined. Statistics per ``by`` are written first and joined:
    Spark broadcasts them when their files are below its threshold.
    """
    if by:
        joined = join_keys(df, durable(stats, "scaler"), by, "left")
        out = joined.withColumns(
            {f"{c}{suffix}": scaled(F.col(c), F.col(f"{c}_center"), F.col(f"{c}_scale")) for c in cols}
        )
        return out.select(*df.columns, *[f"{c}{suffix}" for c in cols])
    one = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    return df.withColumn("_s", one).withColumns(
        {f"{c}{suffix}": scaled(F.col(c), F.col("_s")[f"{c}_center"], F.col("_s")[f"{c}_scale"]) for c in cols}
    ).drop("_s")
