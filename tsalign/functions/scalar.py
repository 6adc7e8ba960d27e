"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative_error(prediction: Column, truth: Column) -> Column:
    return (prediction - truth) / F.greatest(F.abs(truth), F.lit(1e-6))


def is_outlier_iqr(x: Column, q1: Column, q3: Column) -> Column:
    """Beyond 1.5 interquartile ranges from the quartiles."""
    reach = F.lit(1.5) * (q3 - q1)
    return (x < q1 - reach) | (x > q3 + reach)


def is_outlier_z(x: Column, mean: Column, std: Column, limit: float = 3.0) -> Column:
    """More than ``limit`` sample deviations from the mean; false when there is no deviation."""
    return F.coalesce(F.abs(F.try_divide(x - mean, std)) > limit, F.lit(False))


def seeded_order(key: Column, seed: int) -> Column:
    """A repeatable shuffling order: 60 bits of the MD5 of seed and key, as a long."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
