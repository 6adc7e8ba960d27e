"""Feature tables bucketed by their row key: gluing them moves no row.

Each table is shuffled once, when it is written. Every later zip reads the
buckets of all tables side by side, however many training runs there are. Row
keys are unique, so the buckets are even whatever the size of an asset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_KEY = "row_key"
"""The column that the tables are bucketed and sorted by."""


def row_key(keys: Sequence[str]) -> Column:
    """Several columns as one string, NULL included: ``-`` if NULL, else length, colon and value, one after another."""
    parts = []
    for k in keys:
        text = F.col(k).cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.concat(*parts)


def write_bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` as the table ``name`` of the session's catalog, in ``buckets`` buckets; the table is returned.

    Tables that are to meet without a shuffle have equal ``keys`` and
    ``buckets``. The rows go to their buckets first, so every task writes one
    file and the number of files is that of the buckets. The table enters the catalog after its files
    are committed: a killed write leaves none. A table of that name is replaced.
    """
    if ROW_KEY in df.columns:
        raise ValueError(f"the table has a column {ROW_KEY}")
    keyed = df.withColumn(ROW_KEY, row_key(keys)).repartition(buckets, ROW_KEY)
    writer = keyed.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, ROW_KEY).sortBy(ROW_KEY).saveAsTable(name)
    return df.sparkSession.table(name)


def zip_bucketed(
    spark: SparkSession, names: Sequence[str], keys: Sequence[str] = ("asset", "split", "row_idx"), missing: str = "error"
) -> DataFrame:
    """The tables ``names`` side by side by row key: the keys, then every table's other columns.

    The first table is the spine. A row of it that another table lacks fails
    the query, with ``missing="null"`` it stays and that table's columns are
    NULL. A row that the spine lacks always fails the query: it would be lost
    otherwise. NULL in a key matches NULL. Left joins keep the bucketing of
    the spine, which full outer joins would not.
    """
    if missing not in ("error", "null"):
        raise ValueError(f"unknown missing: {missing}")
    spine = spark.table(names[0])
    glued, whole = spine, F.lit(True)
    for i, name in enumerate(names[1:]):
        other = spark.table(name).drop(*keys).withColumn(f"_in_{i}", F.lit(True))
        glued = glued.join(other, ROW_KEY, "left")
        whole = whole & F.col(f"_in_{i}").isNotNull()
    if missing == "error":
        glued = glued.where(F.when(whole, True).otherwise(_failed("a modality lacks row ")))
    marks = [f"_in_{i}" for i in range(len(names) - 1)]
    rest = [c for c in glued.columns if c not in {ROW_KEY, *keys, *marks}]
    out = glued.select(*keys, *rest)
    for name in names[1:]:
        # an outer join, since a check that names one side only is moved below an anti join
        listed = spine.select(ROW_KEY, F.lit(True).alias("_in"))
        stray = spark.table(name).select(ROW_KEY).join(listed, ROW_KEY, "left")
        stray = stray.where(F.when(F.col("_in").isNull(), _failed("the first modality lacks row ")).otherwise(False))
        out = out.union(stray.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema]))
    return out


def _failed(message: str) -> Column:
    return F.raise_error(F.concat(F.lit(message), F.col(ROW_KEY))).cast("boolean")
