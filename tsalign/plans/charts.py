"""Inputs of the candle charts: indicators on the whole series, then one window per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.functions.time import hour_number
from tsalign.operators.chunk import CHUNK_ROWS, grid_index
from tsalign.operators.durable import durable
from tsalign.operators.filters import drop_any_null, image_key, require_columns
from tsalign.operators.indicators import indicators
from tsalign.operators.windows import candle_windows

CANDLE = ["timestamp", "open", "high", "low", "close", "volume", "MA7", "MA25", "RSI", "MACD", "MACD_signal", "MACD_hist"]


def chart_windows(
    klines: DataFrame, by: Sequence[str] = ("asset",), size: int = 24, folder: str = "charts", rows: int = CHUNK_ROWS
) -> DataFrame:
    """``(asset, timestamp, unix_ts, image_path, candles)`` for every row with a complete indicator set."""
    by = list(by)
    require_columns(klines, [*by, *CANDLE[:6]])
    hour = hour_number("timestamp")
    indexed = durable(grid_index(klines.select(*by, *CANDLE[:6], hour.alias("_hour")), by, "_hour", rows=rows), "bars")
    ready = durable(drop_any_null(indicators(indexed, by, "row_idx", rows=rows), CANDLE), "indicators")
    windows = candle_windows(grid_index(ready, by, "row_idx", "_at", rows=rows), by, "_at", CANDLE, size, rows=rows)
    return windows.select(
        *by,
        "timestamp",
        F.unix_seconds("timestamp").alias("unix_ts"),
        image_key(by[0], "timestamp", folder).alias("image_path"),
        "candles",
    )
