"""Kernel density of features per group (the data of a violin plot), from binned counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import join_keys
from tsalign.operators.durable import durable


def density(df: DataFrame, by: Sequence[str], cols: Sequence[str], points: int = 64, spread: float = 2.0) -> DataFrame:
    """``by, feature, point, x, density``: a Gaussian estimate at ``points`` places from ``min - spread * h`` to ``max + spread * h``.

    The bandwidth ``h`` is Scott's, ``std * n ** -0.2`` with the sample deviation.
    Every value counts at its nearest place, and the counts of a group (at most
    ``points``) are convolved with the kernel: two scans of the rows, and no row
    ever meets another. NULLs are left out; a group of equal values, or of one,
    has its whole mass at one place, with a density of NULL.
    """
    names = {c: f"_f{i}" for i, c in enumerate(cols)}
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in names])).alias("_x"))
    long = long.select(*by, F.col("_x.feature").alias("feature"), F.col("_x.v").alias("_v")).where(F.col("_v").isNotNull())
    keys = [*by, "feature"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.stddev_samp("_v").alias("_s")
    )
    h = F.coalesce(F.col("_s") * F.pow("_n", F.lit(-0.2)), F.lit(0.0))
    stats = stats.withColumn("_h", h)
    start = F.col("_low") - spread * F.col("_h")
    step = (F.col("_high") - F.col("_low") + 2 * spread * F.col("_h")) / (points - 1)
    stats = durable(stats.select(*keys, "_n", "_h", start.alias("_start"), step.alias("_step")), "density")
    place = F.coalesce(F.try_divide(F.col("_v") - F.col("_start"), F.col("_step")), F.lit(0.0))
    counts = join_keys(long, stats, keys).groupBy(*keys, F.floor(place + 0.5).cast("int").alias("_bin")).agg(F.count(F.lit(1)).alias("c"))
    bins = counts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_bin", "c"))).alias("_bins"))
    rows = join_keys(bins, stats, keys).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    away = lambda b: (F.col("point") - b["_bin"]) * F.col("_step") / F.col("_h")
    mass = F.aggregate("_bins", F.lit(0.0), lambda acc, b: acc + b["c"] * F.exp(-0.5 * away(b) * away(b)))
    value = F.when(F.col("_h") > 0, mass / (F.col("_n") * F.col("_h") * F.sqrt(F.lit(2) * F.pi())))
    return rows.select(*keys, "point", (F.col("_start") + F.col("point") * F.col("_step")).alias("x"), value.alias("density"))
