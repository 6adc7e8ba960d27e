"""Equi joins on time, files, statistics and claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import outer_join_keys


def left_join_on_time(left: DataFrame, right: DataFrame, on: str | Sequence[str] = "timestamp") -> DataFrame:
    """Plain left join: a repeated right stamp repeats the left row."""
    return left.join(right, [on] if isinstance(on, str) else list(on), "left")


def keep_with_asset_file(df: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose file is listed in the manifest."""
    return df.join(manifest.select(*keys), list(keys), "left_semi")


def missing_asset_files(df: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose file is not listed in the manifest."""
    return df.join(manifest.select(*keys), list(keys), "left_anti")


def asset_file_report(df: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: files found and missing."""
    listed = manifest.select(*keys).distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, list(keys), "left").agg(
        F.count("_listed").alias("found"), F.count_if(F.col("_listed").isNull()).alias("missing")
    )


def join_perp_metrics(
    open_interest: DataFrame, liquidations: DataFrame, ratio: DataFrame, keys: Sequence[str] = ("timestamp", "asset")
) -> DataFrame:
    """Three hourly tables side by side on ``(timestamp, asset)``."""
    return open_interest.join(liquidations, list(keys)).join(ratio, list(keys))


def compare_to_claims(
    actual: DataFrame, claims: DataFrame, keys: Sequence[str], tolerance: float = 0.01
) -> DataFrame:
    """``actual`` against ``claimed``: difference and whether it is below the tolerance.

    A claim about something that is not there stays and is not ok.
    """
    gap = F.col("actual") - F.col("claimed")
    return outer_join_keys(actual, claims, keys).withColumns(
        {"difference": gap, "ok": F.coalesce(F.abs(gap) < F.lit(tolerance), F.lit(False))}
    )


def zip_modalities(
    tables: Sequence[DataFrame], keys: Sequence[str] = ("asset", "split", "row_idx"), missing: str = "error"
) -> DataFrame:
    """Feature tables glued by row key instead of by file position.

    A key that some table lacks fails the query, with ``missing="null"`` it
    stays and that table's columns are NULL.
    """
    if missing not in ("error", "null"):
        raise ValueError(f"unknown missing: {missing}")
    marks = [f"_in_{i}" for i in range(len(tables))]
    tagged = [t.withColumn(m, F.lit(True)) for t, m in zip(tables, marks)]
    glued = tagged[0]
    for other in tagged[1:]:
        glued = outer_join_keys(glued, other, keys)
    if missing == "error":
        whole = F.lit(True)
        for m in marks:
            whole = whole & F.col(m).isNotNull()
        where = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        glued = glued.where(F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("a modality lacks row "), where)).cast("boolean")))
    return glued.drop(*marks)


def modality_counts_match(tables: Sequence[DataFrame], keys: Sequence[str] = ("asset", "split")) -> DataFrame:
    """Per key: rows in each table and whether all counts agree."""
    counts = None
    for i, table in enumerate(tables):
        one = table.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"rows_{i}"))
        counts = one if counts is None else outer_join_keys(counts, one, keys)
    names = [f"rows_{i}" for i in range(len(tables))]
    counts = counts.na.fill(0, names)
    same = F.lit(True)
    for n in names[1:]:
        same = same & (F.col(n) == F.col(names[0]))
    return counts.withColumn("equal", same)
