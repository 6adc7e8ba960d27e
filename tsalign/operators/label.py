"""Returns, volatility and the volatility-normalised forward-return label.

``pos`` is always a 0-based dense row index per ``by`` (see ``chunk``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import CHUNK_ROWS, forward_fill, framed, home_rows

EPSILON = 1e-6


def _padded(df: DataFrame, by, pos, col, pad, rows) -> tuple[DataFrame, str]:
    """The column to take returns of: forward-filled when it may hold NULL and padding is on."""
    if not pad or not df.schema[col].nullable:
        return df, col
    return forward_fill(df, by, pos, {col: "_padded"}, rows), "_padded"


def _rolling_std(spread: DataFrame, by, pos, col, window, name) -> DataFrame:
    """Sample deviation of the last ``window`` values on a :func:`framed` table, in constant work per row.

    Spark re-aggregates a sliding frame for every row. Cut at multiples of
    ``window`` instead, a frame is the end of one block and the start of the
    next: both are running aggregates, forwards and backwards, and their counts,
    means and squared deviations merge without cancellation. Means are taken
    relative to a value of the block, so a constant frame gives exactly 0.
    """
    cut = spread.withColumn("_cut", F.floor(F.col(pos) / window))
    block = Window.partitionBy(*by, "_chunk", "_cut")
    so_far = (Window.unboundedPreceding, Window.currentRow)
    forward = block.orderBy(F.col(pos)).rowsBetween(*so_far)
    backward = block.orderBy(F.col(pos).desc()).rowsBetween(*so_far)
    in_order = Window.partitionBy(*by, "_chunk").orderBy("_cut", pos)

    def running(df: DataFrame, w, tag: str) -> DataFrame:
        x, near = F.col(col), F.col(f"_near_{tag}")
        return df.withColumn(f"_near_{tag}", F.first(col, True).over(w)).withColumn(
            f"_m_{tag}",
            F.struct(
                F.count(x).over(w).alias("n"),
                near.alias("near"),
                F.avg(x - near).over(w).alias("off"),
                F.var_pop(x).over(w).alias("var"),
            ),
        ).drop(f"_near_{tag}")

    both = running(running(cut, forward, "head"), backward, "tail")
    # The tail that completes a head starts window - 1 rows earlier; a head that ends its block is complete alone.
    alone = F.pmod(F.col(pos), F.lit(window)) == window - 1
    both = both.withColumn("_m_tail", F.when(~alone, F.lag("_m_tail", window - 1).over(in_order)))
    head, tail = F.col("_m_head"), F.col("_m_tail")
    n1, n2 = head["n"].cast("double"), F.coalesce(tail["n"], F.lit(0)).cast("double")
    gap = (head["near"] - tail["near"]) + (head["off"] - tail["off"])
    spread_of = lambda m: F.coalesce(m["var"] * m["n"], F.lit(0.0))
    merged = spread_of(head) + spread_of(tail) + F.coalesce(gap * gap * n1 * n2 / F.nullif(n1 + n2, F.lit(0.0)), F.lit(0.0))
    std = F.when(n1 + n2 > 1, F.sqrt(merged / (n1 + n2 - 1)))
    return both.withColumn(name, std).drop("_cut", "_m_head", "_m_tail")


def pct_change(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str,
    name: str = "pct_change",
    pad: bool = True,
    rows: int = CHUNK_ROWS,
    periods: int = 1,
) -> DataFrame:
    """``x / previous - 1`` over ``periods`` rows (momentum). With ``pad`` a NULL repeats the last value, so its own change is 0."""
    df, src = _padded(df, by, pos, col, pad, rows)
    spread, w = framed(df, by, pos, back=periods, rows=rows)
    out = spread.withColumn(name, F.try_divide(F.col(src), F.lag(src, periods).over(w)) - 1)
    return home_rows(out, pos, rows).drop("_padded")


def rolling_vol(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str,
    window: int = 168,
    name: str = "volatility",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sample standard deviation of the last ``window`` values; NULL below two values."""
    spread, _ = framed(df, by, pos, back=window - 1, rows=rows)
    return home_rows(_rolling_std(spread, by, pos, col, window, name), pos, rows)


def forward_return(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str,
    horizon: int = 24,
    name: str = "forward_return",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """``(x[+h] - x) / x``, NULL at the tail."""
    spread, w = framed(df, by, pos, ahead=horizon, rows=rows)
    out = spread.withColumn(name, F.try_divide(F.lead(col, horizon).over(w) - F.col(col), F.col(col)))
    return home_rows(out, pos, rows)


def target_score(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str = "close",
    horizon: int = 24,
    window: int = 168,
    mode: str = "raw",
    pad: bool = True,
    name: str = "target_score",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Forward return over recent volatility; rows without a target are dropped.

    ``raw`` is ``R / (σ + 1e-6)``; ``tanh`` is ``tanh(R / (1.5 σ)) * 100``. One
    shuffle serves return, volatility and forward return.
    """
    if mode not in ("raw", "tanh"):
        raise ValueError(f"unknown mode: {mode}")
    df, src = _padded(df, by, pos, col, pad, rows)
    spread, w = framed(df, by, pos, back=window, ahead=horizon, rows=rows)
    spread = spread.withColumns(
        {
            "_change": F.try_divide(F.col(src), F.lag(src).over(w)) - 1,
            "_ahead": F.try_divide(F.lead(col, horizon).over(w) - F.col(col), F.col(col)),
        }
    )
    spread = _rolling_std(spread, by, pos, "_change", window, "_vol")
    if mode == "raw":
        score = F.try_divide(F.col("_ahead"), F.col("_vol") + F.lit(EPSILON))
    else:
        score = F.tanh(F.try_divide(F.col("_ahead"), F.lit(1.5) * F.col("_vol"))) * 100
    out = home_rows(spread.withColumn(name, score), pos, rows)
    return out.where(F.col(name).isNotNull()).drop("_change", "_vol", "_ahead", "_padded")


def return_1h(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str = "close",
    pad: bool = True,
    name: str = "return_1h",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Percent change to the previous surviving row, 0 on the first."""
    out = pct_change(df, by, pos, col, "_step", pad, rows)
    return out.withColumn(name, F.coalesce(F.col("_step") * 100, F.lit(0.0))).drop("_step")
