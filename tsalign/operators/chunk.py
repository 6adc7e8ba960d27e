"""Ordered work in chunks, so that no key, however large, becomes one task.

A series key may hold a third of all rows, so ``Window.partitionBy(key)`` is
never used on the data itself. Instead:

* a row index is built from per-chunk counts plus a prefix sum over the (small)
  table of chunks;
* bounded frames run per ``(key, chunk)``, with the rows that a neighbouring
  chunk's frames need copied into it (the halo);
* unbounded frames run per ``(key, chunk)`` and take the state at the chunk's
  start from a prefix over the table of chunks.

A NULL key is a key of its own: joins match NULL with NULL, as windows do. A row
without a position stays and gets no index.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tsalign.operators.durable import durable

CHUNK_ROWS = 65_536
"""Positions per chunk. A group of a chunked window holds at most this many rows plus its halo."""

_PLACE_BITS = 33
"""``monotonically_increasing_id`` keeps the partition above this bit and the row's position below it."""


def chunk_of(pos: str | Column, rows: int) -> Column:
    """The chunk that position ``pos`` lives in."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(rows)).cast("long")


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, where NULL matches NULL; the columns of ``left`` and the other columns of ``right``."""
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    match = F.lit(True)
    for k, n in named.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    return left.join(other, match, how).drop(*named.values())


def outer_join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join on ``keys``, where NULL matches NULL; each key once, then the other columns of both sides."""
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    other = right.select(*[F.col(c).alias(named.get(c, c)) for c in right.columns])
    match = F.lit(True)
    for k, n in named.items():
        match = match & F.col(k).eqNullSafe(F.col(n))
    one = [F.coalesce(k, n).alias(k) for k, n in named.items()]
    rest = [c for side in (left, right) for c in side.columns if c not in named]
    return left.join(other, match, "full_outer").select(*one, *rest)


def earlier(by: Sequence[str], on: str) -> WindowSpec:
    """All earlier rows of a table of chunks or partitions; never used on the data itself."""
    return Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)


def arrange(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Range-partition by ``(by, order)``, sort, and write with each row's place.

    The range bounds are sampled over the whole composite key, so a hot ``by``
    value spreads over as many partitions as its share of rows. Adds ``_part``
    (ordered partition number) and ``_place`` (global order within equal keys).
    """
    keys = [*by, *order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_place", _PLACE_BITS))
    )
    return durable(placed, "arranged")


def row_index(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    name: str = "row_idx",
    total: str | None = None,
) -> DataFrame:
    """0-based position per ``by`` in any sort order; ``order`` must end in a unique column.

    One range shuffle, no window over the data: the place written by
    :func:`arrange` minus the place of the key's first row in its partition,
    plus the rows in earlier partitions.
    """
    placed = arrange(df, by, order)
    parts = placed.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_in_part"), F.min("_place").alias("_first"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_in_part").over(earlier(by, "_part")), F.lit(0)))
    if total:
        parts = parts.withColumn(total, F.sum("_in_part").over(Window.partitionBy(*by)))
    parts = durable(parts.drop("_in_part"), "parts")
    indexed = join_keys(placed, parts, [*by, "_part"])
    keep = [*df.columns, *([total] if total else [])]
    return indexed.select(*keep, (F.col("_place") - F.col("_first") + F.col("_before")).alias(name))


def grid_index(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    name: str = "row_idx",
    total: str | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """0-based position per ``by`` along an integer column that is unique per ``by``.

    Uniqueness bounds a chunk of ``rows`` consecutive values to ``rows`` rows,
    whatever the data. Lazy: one narrow count pass and one shuffle. Use grid
    units (hours, days, an earlier index), not raw epochs, so chunks are full.
    Rows without a position spread over groups below all chunks and get no index.
    """
    sizes = df.where(F.col(pos).isNotNull()).groupBy(*by, chunk_of(pos, rows).alias("_chunk"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("_in_chunk"))
    chunked = df.withColumn("_chunk", F.coalesce(chunk_of(pos, rows), -1 - F.spark_partition_id().cast("long")))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_in_chunk").over(earlier(by, "_chunk")), F.lit(0)))
    if total:
        sizes = sizes.withColumn(total, F.sum("_in_chunk").over(Window.partitionBy(*by)))
    within = Window.partitionBy(*by, "_chunk").orderBy(pos)
    indexed = join_keys(chunked, sizes.drop("_in_chunk"), [*by, "_chunk"], "left")
    keep = [c for c in df.columns if c not in (name, total)]
    extra = [total] if total else []
    return indexed.select(*keep, *extra, (F.row_number().over(within) - 1 + F.col("_before")).alias(name))


def framed(
    df: DataFrame, by: Sequence[str], pos: str, back: int = 0, ahead: int = 0, rows: int = CHUNK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Copy each row into every chunk whose frames reach it; return the frame and its window.

    ``pos`` is a 0-based dense index. A row at ``p`` is read by frames of rows
    ``p - ahead .. p + back``. Add window columns over the returned spec, then
    call :func:`home_rows`.
    """
    at = F.col(pos)
    first = chunk_of(F.greatest(at - F.lit(ahead), F.lit(0)), rows)
    last = chunk_of(at + F.lit(back), rows)
    spread = df.withColumn("_chunk", F.explode(F.sequence(first, last)))
    return spread, Window.partitionBy(*by, "_chunk").orderBy(pos)


def home_rows(df: DataFrame, pos: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Drop the halo copies made by :func:`framed`."""
    return df.where(F.col("_chunk") == chunk_of(pos, rows)).drop("_chunk")


def forward_fill(
    df: DataFrame, by: Sequence[str], pos: str, cols: dict[str, str], rows: int = CHUNK_ROWS
) -> DataFrame:
    """``{source: target}``: last non-NULL value so far, over any distance."""
    chunked = df.withColumn("_chunk", chunk_of(pos, rows))
    tails = chunked.groupBy(*by, "_chunk").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_tail_{t}") for c, t in cols.items()]
    )
    before = earlier(by, "_chunk")
    carried = tails.select(
        *by, "_chunk", *[F.last(f"_tail_{t}", True).over(before).alias(f"_carry_{t}") for t in cols.values()]
    )
    joined = join_keys(chunked, carried, [*by, "_chunk"], "left")
    so_far = Window.partitionBy(*by, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = joined.withColumns(
        {t: F.coalesce(F.last(c, True).over(so_far), F.col(f"_carry_{t}")) for c, t in cols.items()}
    )
    return filled.drop("_chunk", *[f"_carry_{t}" for t in cols.values()])


def running_min_before(
    df: DataFrame, by: Sequence[str], pos: str, col: str, name: str, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Minimum of ``col`` over all earlier rows of the key; NULL on the first."""
    chunked = df.withColumn("_chunk", chunk_of(pos, rows))
    lows = chunked.groupBy(*by, "_chunk").agg(F.min(col).alias("_low"))
    carried = lows.select(*by, "_chunk", F.min("_low").over(earlier(by, "_chunk")).alias("_carry"))
    before = Window.partitionBy(*by, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    joined = join_keys(chunked, carried, [*by, "_chunk"], "left")
    return joined.withColumn(name, F.least(F.min(col).over(before), F.col("_carry"))).drop("_chunk", "_carry")
