"""Writers and the inventory of what they wrote."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.sources import committed

# Feature tables per split.
MODALITIES = ["text", "image", "tabular", "target"]


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Overwrite ``path`` with CSV (header, no index) or Parquet."""
    if kind == "csv":
        df.write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").parquet(path)


def write_splits(df: DataFrame, path: str, order: str = "timestamp") -> None:
    """Parquet folders per asset and split.

    Rows are range-partitioned on ``(asset, split, time)``: a large asset takes
    many tasks, each writes few files, and file statistics prune on time.
    """
    keys = ["asset", "split"]
    df.repartitionByRange(*keys, order).write.partitionBy(*keys).mode("overwrite").parquet(path)


def write_features(tables: Mapping[str, DataFrame], path: str, split: str, force: bool = False) -> list[str]:
    """One committed table per modality of a split; returns the modalities written.

    What is present (see :mod:`tsalign.sources.committed`) stays unless ``force``;
    what a killed write left is not present and is written anew.
    """
    written = []
    for modality, table in tables.items():
        place = f"{path}/{modality}/split={split}"
        if force or committed.manifest(table.sparkSession, place) is None:
            committed.commit(table, place)
            written.append(modality)
    return written


def read_features(spark: SparkSession, path: str, modality: str, split: str | None = None) -> DataFrame | None:
    """The rows of a modality with their ``split``, of one split or of all present; None if there are none."""
    out = None
    for one in [split] if split is not None else committed.partitions(spark, f"{path}/{modality}", "split"):
        table = committed.read(spark, f"{path}/{modality}/split={one}")
        if table is not None:
            table = table.withColumn("split", F.lit(one))
            out = table if out is None else out.unionByName(table, allowMissingColumns=True)
    return out


def feature_inventory(
    spark: SparkSession, path: str, columns: Mapping[str, str], modalities: Sequence[str] = MODALITIES
) -> DataFrame:
    """Per split: rows and vector length of each feature table, all present, equal counts.

    ``columns`` names the value column of each modality; a scalar has length 1.
    Rows come from the manifests; only vector columns are scanned.
    """
    rows = []
    for m in modalities:
        for split in committed.partitions(spark, f"{path}/{m}", "split"):
            known = committed.manifest(spark, f"{path}/{m}/split={split}")
            if known is not None:
                rows.append((m, split, known["rows"]))
    counts = spark.createDataFrame(rows, "modality string, split string, rows long")
    out = counts.groupBy("split").pivot("modality", list(modalities)).agg(F.first("rows"))
    out = out.select("split", *[F.col(m).alias(f"{m}_rows") for m in modalities])
    for m in modalities:
        table = read_features(spark, path, m)
        if table is None:
            lengths = counts.select("split", F.lit(None).cast("int").alias(f"{m}_dim"), F.lit(None).cast("boolean").alias(f"_{m}_even")).limit(0)
        else:
            length = F.size(columns[m]) if dict(table.dtypes)[columns[m]].startswith("array") else F.lit(1)
            lengths = table.groupBy("split").agg(F.max(length).alias(f"{m}_dim"), (F.max(length) == F.min(length)).alias(f"_{m}_even"))
        out = out.join(lengths, "split", "left")
    present, equal, even = F.lit(True), F.lit(True), F.lit(True)
    for m in modalities:
        present = present & F.col(f"{m}_rows").isNotNull()
        equal = equal & (F.col(f"{m}_rows") == F.col(f"{modalities[0]}_rows"))
        even = even & F.col(f"_{m}_even")
    sizes = [F.col(f"{m}_{c}") for m in modalities for c in ("rows", "dim")]
    return out.select(
        "split",
        *sizes,
        present.alias("complete"),
        F.coalesce(equal, F.lit(False)).alias("equal_counts"),
        F.coalesce(even, F.lit(False)).alias("even_vectors"),
    )
