"""Backward as-of join: every left row with the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import arrange, earlier, join_keys
from tsalign.operators.durable import durable


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    on: str,
    by: Sequence[str] = (),
    values: Sequence[str] | None = None,
    order: Sequence[str] = (),
    clip_by: Sequence[str] | None = None,
) -> DataFrame:
    """Attach ``values`` of the latest right row with ``right.on <= left.on``.

    Exact hits match, there is no tolerance, and a left row before the first
    right row gets NULL. Equal right stamps are resolved by ``order`` (last
    wins). A right table without the series key is joined with ``by=()``.
    ``clip_by`` drops right rows older than the first left row, of the whole
    left table (``[]``) or of each left key.

    Both sides are unioned and range-partitioned on ``(by, on, …)``; each
    partition fills forward on its own and takes the right row current at its
    start from a prefix over the partitions, so neither side needs to be small
    and no key needs to fit in one task.
    """
    by, order = list(by), list(order)
    values = list(values) if values else [c for c in right.columns if c not in (on, *by, *order)]
    rank = [f"_rank_{i}" for i in range(len(order))]

    rights = right.na.drop(subset=[on, *by]).select(
        *by,
        F.col(on).alias("_on"),
        F.lit(0).alias("_side"),
        *[F.col(c).alias(r) for c, r in zip(order, rank)],
        F.lit(0).cast("long").alias("_tie"),
        F.struct(F.col(on).alias("_stamp"), *[F.col(v) for v in values]).alias("_hit"),
    )
    lefts = left.select(
        *by,
        F.col(on).alias("_on"),
        F.lit(1).alias("_side"),
        F.xxhash64(*left.columns).alias("_tie"),
        F.struct(*left.columns).alias("_row"),
    )
    both = rights.unionByName(lefts, allowMissingColumns=True)
    placed = arrange(both, by, ["_on", "_side", *rank, "_tie"])

    tails = placed.groupBy(*by, "_part").agg(
        F.max_by("_hit", F.when(F.col("_side") == 0, F.col("_place"))).alias("_tail")
    )
    carried = tails.select(*by, "_part", F.last("_tail", True).over(earlier(by, "_part")).alias("_carry"))
    so_far = (
        Window.partitionBy(*by, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    matched = (
        placed.join(carried, [*by, "_part"], "left")
        .withColumn("_hit", F.coalesce(F.last("_hit", True).over(so_far), F.col("_carry")))
        .where(F.col("_side") == 1)
    )
    if clip_by is None:
        return matched.select("_row.*", *[F.col("_hit")[v].alias(v) for v in values])

    # the written rows hold the left keys already, so the left side is not evaluated again
    own = placed.where(F.col("_side") == 1)
    matched = matched.select("_row.*", "_hit")
    if clip_by:
        firsts = own.groupBy(*[F.col("_row")[c].alias(c) for c in clip_by]).agg(F.min("_on").alias("_first"))
        matched = join_keys(matched, durable(firsts, "firsts"), list(clip_by), "left")
        first = F.col("_first")
    else:
        first = own.agg(F.min("_on")).scalar()
    inside = F.col("_hit")["_stamp"] >= first
    return matched.select(*left.columns, *[F.when(inside, F.col("_hit")[v]).alias(v) for v in values])


def clip_to_range_of(right: DataFrame, left: DataFrame, on: str) -> DataFrame:
    """Right rows inside ``[min, max]`` of the left key column."""
    return right.where(F.col(on).between(left.agg(F.min(on)).scalar(), left.agg(F.max(on)).scalar()))
