"""Systematic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import row_index


def sample_positions(df: DataFrame, pos: str, m: int = 100) -> DataFrame:
    """``m`` rows evenly spread from first to last: positions ``int(k * (n-1)/(m-1))``.

    ``pos`` is unique and gives the order. Whether a row is picked
    follows from its own position, so there is nothing to join.
    """
    indexed = row_index(df, [], [pos], "sample_pos", total="_n")
    at, n = F.col("sample_pos"), F.col("_n")
    picks = F.least(n, F.lit(m))
    step = F.try_divide((n - 1).cast("double"), picks - 1)
    near = F.floor(F.try_divide(at.cast("double"), step)).cast("long")
    lands = lambda k: (k >= 0) & (k < picks - 1) & (F.floor(k * step) == at)
    hit = lands(near - 1) | lands(near) | lands(near + 1) | ((picks > 1) & (at == n - 1)) | (at == 0)
    return indexed.where(hit & (picks > 0)).drop("_n")
