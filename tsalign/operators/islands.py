"""Runs of rows above a threshold (liquidation cascades), over series of any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import CHUNK_ROWS, chunk_of, earlier, join_keys


def cascades(
    df: DataFrame, by: Sequence[str], pos: str, value: str, at_least: float, least_rows: int = 1, bridge: int = 0, rows: int = CHUNK_ROWS
) -> DataFrame:
    """``by, first, last, n_rows, total, peak`` of every run of rows whose ``value`` is at least ``at_least``.

    ``pos`` is a dense index. Up to ``bridge`` rows below the threshold (or NULL)
    between two rows above it do not end a run; ``n_rows``, ``total`` and ``peak`` are
    of the rows above it. Runs with fewer than ``least_rows`` of them are left out.

    Runs are found inside chunks of the index; a run that goes on over the edges of
    chunks is put together over the table of the runs' ends, two for each chunk, so a
    hot series takes as many tasks as it has chunks.
    """
    hot = df.where(F.col(value) >= at_least).select(*by, F.col(pos).alias("_at"), F.col(value).alias("_v")).withColumn("_chunk", chunk_of("_at", rows))
    inside = Window.partitionBy(*by, "_chunk").orderBy("_at")
    start = F.coalesce((F.col("_at") - F.lag("_at").over(inside) > bridge + 1).cast("int"), F.lit(1))
    numbered = hot.withColumn("_starts", start)
    numbered = numbered.withColumn("_run", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = numbered.groupBy(*by, "_chunk", "_run").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.count(F.lit(1)).alias("n_rows"), F.sum("_v").alias("total"), F.max("_v").alias("peak")
    )
    # the last row above the threshold before a chunk, over any number of chunks without one
    ends = pieces.groupBy(*by, "_chunk").agg(F.max("last").alias("_end"), F.max("_run").alias("_runs"), F.min("first").alias("_begin"))
    before = earlier(by, "_chunk")
    joins = F.coalesce(F.col("_begin") - F.max("_end").over(before) <= bridge + 1, F.lit(False))
    ends = ends.withColumn("_joins", joins)
    # chunks whose only run goes on from the one before belong to the chunk where it began
    opens = ~F.col("_joins") | (F.col("_runs") > 1)
    ends = ends.withColumn("_from", F.last(F.when(opens, F.col("_chunk")), True).over(before))
    owned = join_keys(pieces, ends.select(*by, "_chunk", "_joins", "_from"), [*by, "_chunk"])
    goes_on = F.col("_joins") & (F.col("_run") == 1)
    owner = F.when(goes_on, F.struct(F.col("_from").alias("c"), F.lit(None).cast("long").alias("r"))).otherwise(F.struct(F.col("_chunk").alias("c"), F.col("_run").alias("r")))
    last_run = ends.select(*by, F.col("_chunk").alias("_of"), F.col("_runs").alias("_last"))
    owned = owned.withColumns({"_of": owner["c"], "_number": owner["r"]})
    owned = join_keys(owned, last_run, [*by, "_of"], "left")
    owned = owned.withColumn("_number", F.coalesce("_number", "_last"))
    out = owned.groupBy(*by, "_of", "_number").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n_rows").alias("n_rows"), F.sum("total").alias("total"), F.max("peak").alias("peak")
    )
    return out.where(F.col("n_rows") >= least_rows).drop("_of", "_number")
