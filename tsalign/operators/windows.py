"""Row windows as arrays, gaps, null context, shifted correlation and run histories.

``pos`` is a 0-based dense row index per ``by`` (see ``chunk``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import CHUNK_ROWS, framed, home_rows, join_keys, running_min_before
from tsalign.operators.durable import durable


def candle_windows(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    cols: Sequence[str],
    size: int = 24,
    name: str = "candles",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per row the last ``size`` rows as an array of structs; shorter than half the size is skipped."""
    spread, w = framed(df, by, pos, back=size - 1, rows=rows)
    out = spread.withColumn(name, F.collect_list(F.struct(*cols)).over(w.rowsBetween(-(size - 1), 0)))
    return home_rows(out, pos, rows).where(F.size(name) >= size // 2)


def sequence_windows(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    features: Sequence[str],
    target: str,
    keys: Sequence[str] = (),
    length: int = 24,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Sample ``idx``: feature rows ``idx … idx+length-1``, target and keys of row ``idx+length``.

    Only the named columns travel. A series no longer than ``length`` has no
    sample; :func:`short_series` lists those. NULLs keep their place. With ``by=[]`` windows run over
    the concatenation of all series.
    """
    slim = df.select(*dict.fromkeys([*by, pos, *features, target, *keys]))
    spread, w = framed(slim, by, pos, back=length, rows=rows)
    past = w.rowsBetween(-length, -1)
    # one list of structs: a list of a column would leave its NULLs out and fall short
    seen = F.collect_list(F.struct(*features)).over(past)
    full = home_rows(spread.withColumn("_seq", seen), pos, rows).where(F.col(pos) >= length)
    carried = [c for c in dict.fromkeys([*by, *keys]) if c not in features]
    return full.select(
        *carried,
        (F.col(pos) - length).alias("idx"),
        *[F.col("_seq")[f].alias(f) for f in features],
        F.col(target).alias("target"),
    )


def short_series(df: DataFrame, by: Sequence[str], length: int = 24) -> DataFrame:
    """Series that yield no window."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= length)


def flatten_window(df: DataFrame, col: str, name: str) -> DataFrame:
    """A window of vectors as one vector."""
    return df.withColumn(name, F.flatten(col))


def gap_check(
    df: DataFrame, by: Sequence[str], pos: str, on: str = "timestamp", hours: float = 1.0, rows: int = CHUNK_ROWS
) -> DataFrame:
    """Rows more than ``hours`` after the previous one, with the distance."""
    spread, w = framed(df, by, pos, back=1, rows=rows)
    now = F.unix_micros(F.col(on).cast("timestamp"))
    out = spread.withColumn("gap_hours", (now - F.lag(now).over(w)) / 3_600_000_000.0)
    return home_rows(out, pos, rows).where(F.col("gap_hours") > hours)


def null_context(df: DataFrame, by: Sequence[str], pos: str, col: str, k: int = 2) -> DataFrame:
    """Rows at most ``k`` away from the first NULL of ``col``, flagged when NULL."""
    nulls = df.where(F.col(col).isNull())
    if by:
        firsts = durable(nulls.groupBy(*by).agg(F.min(pos).alias("_first")), "firsts")
        near = join_keys(df, firsts, by).where(F.abs(F.col(pos) - F.col("_first")) <= k).drop("_first")
    else:
        near = df.where(F.abs(F.col(pos) - nulls.agg(F.min(pos)).scalar()) <= k)
    return near.withColumn("is_null", F.col(col).isNull())


def null_positions(df: DataFrame, by: Sequence[str], pos: str, col: str, n: int | None = None) -> DataFrame:
    """The positions holding NULL, all or the first ``n`` per series."""
    nulls = df.where(F.col(col).isNull()).select(*by, pos)
    if n is None:
        return nulls
    if not by:
        return nulls.orderBy(pos).limit(n)
    ranked = nulls.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(pos)))
    return ranked.where(F.col("_rank") <= n).drop("_rank")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are known; 0 when either is constant."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.coalesce(
        F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(0.0)
    )


def lead_lag_corr(
    df: DataFrame, by: Sequence[str], pos: str, a: str, b: str, lags: Sequence[int], rows: int = CHUNK_ROWS
) -> DataFrame:
    """Correlation of ``a`` shifted by each lag with ``b``: rows ``(by, lag, n, corr)``."""
    spread, w = framed(df.select(*by, pos, a, b), by, pos, back=max(lags), rows=rows)
    shifted = spread.withColumns({f"_a{k}": F.lag(a, k).over(w) for k in lags})
    stats = home_rows(shifted, pos, rows).groupBy(*by).agg(
        *[
            F.struct(
                F.lit(k).alias("lag"),
                F.count_if(F.col(f"_a{k}").isNotNull() & F.col(b).isNotNull()).alias("n"),
                pearson(F.col(f"_a{k}"), F.col(b)).alias("corr"),
            ).alias(f"_r{k}")
            for k in lags
        ]
    )
    return stats.select(*by, F.inline(F.array(*[F.col(f"_r{k}") for k in lags])))


def running_best(
    df: DataFrame, by: Sequence[str], pos: str, loss: str = "val_mse", rows: int = CHUNK_ROWS
) -> DataFrame:
    """Best earlier loss and whether this row is strictly better."""
    out = running_min_before(df, by, pos, loss, "best_before", rows)
    return out.withColumn("improved", F.coalesce(F.col(loss) < F.col("best_before"), F.col(loss).isNotNull()))


def keep_last_n(df: DataFrame, by: Sequence[str], pos: str, n: int = 3) -> DataFrame:
    """``keep`` is true for the newest ``n`` entries of each run. ``pos`` is unique per run.

    Each task hands on at most ``n`` entries of a run, however many it has, so
    neither dense positions nor small runs are asked for.
    """
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(pos)))
    last = df.select(*by, pos).withColumn("_rank", newest).where(F.col("_rank") <= n).groupBy(*by).agg(F.min(pos).alias("_last"))
    joined = join_keys(df, last, by, "left")
    return joined.withColumn("keep", F.coalesce(F.col(pos) >= F.col("_last"), F.lit(False))).drop("_last")
