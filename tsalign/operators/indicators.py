"""Moving averages, recursive averages and the indicators built on them.

``pos`` is a 0-based dense row index per ``by`` (see ``chunk``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import CHUNK_ROWS, chunk_of, forward_fill, framed, grid_index, home_rows, join_keys
from tsalign.operators.durable import durable

_BLOCK_DECAY = 150 * math.log(10)
"""Natural log of how far a weight may decay inside one block; keeps every power in double range."""
_UNDERFLOW = 745.0
"""exp(-745) is the smallest double, so older blocks add exactly nothing."""


def sma(
    df: DataFrame, by: Sequence[str], pos: str, col: str, windows: dict[str, int], rows: int = CHUNK_ROWS
) -> DataFrame:
    """``{name: n}``: mean of the last ``n`` rows, partial at the start."""
    spread, w = framed(df, by, pos, back=max(windows.values()) - 1, rows=rows)
    out = spread.withColumns({name: F.avg(col).over(w.rowsBetween(-(n - 1), 0)) for name, n in windows.items()})
    return home_rows(out, pos, rows)


def rolling_mean(
    df: DataFrame, by: Sequence[str], pos: str, cols: Sequence[str], n: int, rows: int = CHUNK_ROWS
) -> DataFrame:
    spread, w = framed(df, by, pos, back=n - 1, rows=rows)
    frame = w.rowsBetween(-(n - 1), 0)
    return home_rows(spread.withColumns({f"{c}_mean_{n}": F.avg(c).over(frame) for c in cols}), pos, rows)


def lag_features(
    df: DataFrame, by: Sequence[str], pos: str, cols: Sequence[str], lags: Sequence[int], rows: int = CHUNK_ROWS
) -> DataFrame:
    """``{col}_lag_{k}`` for each column and lag."""
    spread, w = framed(df, by, pos, back=max(lags), rows=rows)
    out = spread.withColumns({f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags})
    return home_rows(out, pos, rows)


@dataclass(frozen=True)
class Ema:
    """One recursive average: ``y = (1 - alpha) * y + alpha * x``, seeded with the first value.

    ``lead`` is how many rows at the start of every series hold no value yet;
    ``min_periods`` values must have been seen before the result shows.
    Without ``holes`` every later row must hold a value; see :func:`ema`.
    """

    col: str
    name: str
    alpha: float
    min_periods: int = 0
    lead: int = 0

    @staticmethod
    def span(col: str, name: str, span: int, min_periods: int = 0, lead: int = 0) -> Ema:
        return Ema(col, name, 2.0 / (span + 1.0), min_periods, lead)


def ema(
    df: DataFrame, by: Sequence[str], pos: str, specs: Sequence[Ema], rows: int = CHUNK_ROWS, holes: bool = False
) -> DataFrame:
    """Recursive averages as plain sums, all specs in one pass.

    With ``holes`` any row may be NULL: the first value seeds, a NULL row shows
    the average so far, the weight of the past decays over it, and
    ``min_periods`` counts values. Without, a NULL after the lead fails the
    query, since the sums below would silently read it as zero.

    Unrolled, the recursion is a sum of ``weight * x * q^age``. Inside a block
    that is a running sum of ``weight * x * q^-i`` times ``q^i``; the state at a
    block's start folds the totals of the few earlier blocks whose weight has
    not underflowed. Blocks are short enough that no power leaves double range.
    """
    q = [1.0 - s.alpha for s in specs]
    if any(not 0.0 < s.alpha < 1.0 for s in specs):
        raise ValueError("alpha must be inside (0, 1)")
    if holes:
        return _ema_over_holes(df, by, pos, specs, rows)
    size = max(1, min(rows, *[int(_BLOCK_DECAY / -math.log(x)) for x in q]))
    reach = 1 + max(math.ceil(_UNDERFLOW / (size * -math.log(x))) for x in q)

    blocked = df.withColumns({"_block": chunk_of(pos, size), "_i": F.pmod(F.col(pos), F.lit(size)).cast("double")})
    full = lambda s: F.when(
        F.col(s.col).isNull() & (F.col(pos) >= s.lead), F.raise_error(F.lit(f"{s.col} has a NULL: use holes=True")).cast("double")
    ).otherwise(F.col(s.col))
    weighted = [
        full(s) * F.when(F.col(pos) == s.lead, F.lit(1.0)).when(F.col(pos) > s.lead, F.lit(s.alpha)).otherwise(0.0)
        for s in specs
    ]

    totals = blocked.groupBy(*by, "_block").agg(
        *[F.coalesce(F.sum(x * F.pow(F.lit(d), size - 1 - F.col("_i"))), F.lit(0.0)).alias(f"_t{k}")
          for k, (x, d) in enumerate(zip(weighted, q))]
    )
    spread, w = framed(totals, by, "_block", back=reach, rows=rows)
    before = w.rowsBetween(-reach, -1)

    def folded(k: int, d: float) -> Column:
        return F.aggregate(
            F.collect_list(f"_t{k}").over(before), F.lit(0.0), lambda acc, t: acc * F.lit(d**size) + t
        ).alias(f"_c{k}")

    carried = home_rows(
        spread.select(*by, "_block", "_chunk", *[folded(k, d) for k, d in enumerate(q)]), "_block", rows
    )
    so_far = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = join_keys(blocked, carried, [*by, "_block"])
    for k, (s, x, d) in enumerate(zip(specs, weighted, q)):
        local = F.sum(x * F.pow(F.lit(d), -F.col("_i"))).over(so_far) * F.pow(F.lit(d), F.col("_i"))
        value = F.coalesce(local, F.lit(0.0)) + F.pow(F.lit(d), F.col("_i") + 1) * F.col(f"_c{k}")
        shown = F.col(pos) >= s.lead + max(s.min_periods, 1) - 1
        joined = joined.withColumn(s.name, F.when(shown, value))
    return joined.drop("_block", "_i", *[f"_c{k}" for k in range(len(specs))])


_OBSERVED = 4096
"""Values per block of a series with holes."""


def _ema_over_holes(df: DataFrame, by: Sequence[str], pos: str, specs: Sequence[Ema], rows: int) -> DataFrame:
    """The recursion over the values only, spread to the NULL rows between them.

    Values get an index of their own, so a block always holds values and the
    past fades within a few blocks however long the holes are. A block yields
    each value's average as a linear function of the average before the block.
    """
    out = df
    for col in dict.fromkeys(s.col for s in specs):
        mine = [(k, s) for k, s in enumerate(specs) if s.col == col]
        seen = durable(df.where(F.col(col).isNotNull()).select(*by, pos, F.col(col).cast("double").alias("_x")), "values")
        indexed = grid_index(seen, by, pos, "_obs", rows=rows)
        spread, w = framed(indexed, by, "_obs", back=1, rows=rows)
        gaps = home_rows(spread.withColumn("_gap", (F.col(pos) - F.lag(pos).over(w)).cast("double")), "_obs", rows)
        blocked = gaps.withColumn("_block", chunk_of("_obs", _OBSERVED))
        fields = ", ".join(f"_a{k} double, _d{k} double" for k, _ in mine)
        keys = [f for f in blocked.schema.fields if f.name in (*by, pos, "_obs", "_block")]
        head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys)
        local = durable(
            blocked.groupBy(*by, "_block").applyInPandas(_block_recursion([f.name for f in keys], mine), f"{head}, {fields}"), "blocks"
        )
        ends = local.groupBy(*by, "_block").agg(
            *[F.max_by(F.struct(f"_a{k}", f"_d{k}"), "_obs").alias(f"_e{k}") for k, _ in mine]
        )
        reach = 1 + max(math.ceil(_UNDERFLOW / (_OBSERVED * -math.log(1.0 - s.alpha))) for _, s in mine)
        near, v = framed(ends, by, "_block", back=reach, rows=rows)
        fold = lambda k: F.aggregate(
            F.collect_list(f"_e{k}").over(v.rowsBetween(-reach, -1)),
            F.lit(0.0),
            lambda acc, e: acc * e[f"_a{k}"] + e[f"_d{k}"],
        ).alias(f"_c{k}")
        carried = home_rows(near.select(*by, "_block", "_chunk", *[fold(k) for k, _ in mine]), "_block", rows)
        valued = join_keys(local, carried, [*by, "_block"]).select(
            *by,
            pos,
            (F.col("_obs") + 1).alias(f"_n_{col}"),
            *[(F.col(f"_a{k}") * F.col(f"_c{k}") + F.col(f"_d{k}")).alias(f"_y{k}") for k, _ in mine],
        )
        out = join_keys(out, valued, [*by, pos], "left")
    counts = {s.col for s in specs}
    out = forward_fill(
        out, by, pos, {**{f"_n_{c}": f"_s_{c}" for c in counts}, **{f"_y{k}": f"_f{k}" for k in range(len(specs))}}, rows
    )
    shown = {s.name: F.when(F.col(f"_s_{s.col}") >= max(s.min_periods, 1), F.col(f"_f{k}")) for k, s in enumerate(specs)}
    names = [*(f"_{m}_{c}" for c in counts for m in "ns"), *(f"_{m}{k}" for k in range(len(specs)) for m in "yf")]
    return out.withColumns(shown).drop(*names)


def _block_recursion(keys: list[str], specs: list[tuple[int, Ema]]):
    """Per value ``_a`` and ``_d``: its average is ``_a`` times the average before the block plus ``_d``."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("_obs")
        out = block[keys].copy()
        x, gap = block["_x"].to_numpy(), block["_gap"].to_numpy()
        for k, s in specs:
            with np.errstate(under="ignore"):
                past = np.power(1.0 - s.alpha, gap)
            keep, take = np.where(np.isnan(gap), 0.0, past / (past + s.alpha)), np.where(np.isnan(gap), 1.0, s.alpha / (past + s.alpha))
            a, d = np.empty(len(x)), np.empty(len(x))
            state_a, state_d = 1.0, 0.0
            for i, (p, t) in enumerate(zip(keep.tolist(), (take * x).tolist())):
                a[i] = state_a = state_a * p
                d[i] = state_d = state_d * p + t
            out[f"_a{k}"], out[f"_d{k}"] = a, d
        return out

    return run


def rsi(
    df: DataFrame, by: Sequence[str], pos: str, col: str = "close", n: int = 14, name: str = "RSI", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Wilder's relative strength; 100 when there were no losses; NULL for ``n - 1`` rows."""
    moved = _with_moves(df, by, pos, col, rows)
    averaged = ema(moved, by, pos, _rsi_specs(n), rows)
    return averaged.withColumn(name, _rsi_value()).drop("_gain", "_loss", "_up", "_down")


def macd(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    col: str = "close",
    fast: int = 12,
    slow: int = 26,
    signal: int = 9,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Fast minus slow average, its signal average, and their difference."""
    averaged = ema(df, by, pos, _macd_specs(col, fast, slow), rows)
    return _with_signal(averaged, by, pos, slow, signal, rows)


def indicators(df: DataFrame, by: Sequence[str], pos: str, col: str = "close", rows: int = CHUNK_ROWS) -> DataFrame:
    """MA7, MA25, RSI, MACD, MACD_signal, MACD_hist with two recursive passes in all."""
    moved = _with_moves(sma(df, by, pos, col, {"MA7": 7, "MA25": 25}, rows), by, pos, col, rows)
    averaged = ema(moved, by, pos, [*_rsi_specs(14), *_macd_specs(col, 12, 26)], rows)
    averaged = averaged.withColumn("RSI", _rsi_value()).drop("_gain", "_loss", "_up", "_down")
    return _with_signal(averaged, by, pos, 26, 9, rows)


def _with_moves(df, by, pos, col, rows):
    spread, w = framed(df, by, pos, back=1, rows=rows)
    step = F.coalesce(F.col(col) - F.lag(col).over(w), F.lit(0.0))
    spread = spread.withColumn("_step", step)
    spread = spread.withColumns(
        {"_gain": F.greatest(F.col("_step"), F.lit(0.0)), "_loss": F.greatest(-F.col("_step"), F.lit(0.0))}
    )
    return home_rows(spread, pos, rows).drop("_step")


def _rsi_specs(n: int) -> list[Ema]:
    return [Ema("_gain", "_up", 1.0 / n, n), Ema("_loss", "_down", 1.0 / n, n)]


def _rsi_value() -> Column:
    strength = F.try_divide(F.col("_up"), F.col("_down"))
    return F.when(F.col("_down") == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + strength))


def _macd_specs(col: str, fast: int, slow: int) -> list[Ema]:
    return [Ema.span(col, "_fast", fast, fast), Ema.span(col, "_slow", slow, slow)]


def _with_signal(df, by, pos, slow, signal, rows):
    line = df.withColumn("MACD", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = ema(line, by, pos, [Ema.span("MACD", "MACD_signal", signal, signal, lead=slow - 1)], rows)
    return out.withColumn("MACD_hist", F.col("MACD") - F.col("MACD_signal"))
