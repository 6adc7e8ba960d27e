"""Ordered operators against pandas, with chunks small enough that every carry and halo is used."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsalign.operators.asof import asof_backward, clip_to_range_of
from tsalign.operators.chunk import forward_fill, grid_index, row_index, running_min_before
from tsalign.operators.indicators import Ema, ema, indicators, lag_features, macd, rsi, sma
from tsalign.operators.label import forward_return, pct_change, return_1h, rolling_vol, target_score
from tsalign.operators.sample import sample_positions
from tsalign.operators.split import batches, chronological_split
from tsalign.operators.windows import (
    candle_windows,
    flatten_window,
    gap_check,
    keep_last_n,
    null_context,
    null_positions,
    sequence_windows,
    short_series,
)

BY = ["asset"]


@pytest.fixture(scope="module")
def prices():
    rng = np.random.default_rng(7)
    parts = []
    for asset, n in (("BTC", 211), ("ETH", 60)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        parts.append(pd.DataFrame({"asset": asset, "row_idx": np.arange(n), "close": close}))
    return pd.concat(parts, ignore_index=True)


@pytest.fixture(scope="module")
def frame(spark, prices):
    return spark.createDataFrame(prices).repartition(5).cache()


def pull(df, col, by=BY, pos="row_idx"):
    return df.toPandas().sort_values([*by, pos])[col].to_numpy(dtype=float)


def same(a, b, tol=1e-9):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=tol, atol=tol)


def per_asset(prices, fn):
    return np.concatenate([np.asarray(fn(g["close"]), float) for _, g in prices.groupby("asset", sort=True)])


@pytest.mark.parametrize("rows", [7, 65_536])
class TestAgainstPandas:
    def test_pct_change(self, frame, prices, rows):
        same(pull(pct_change(frame, BY, "row_idx", "close", rows=rows), "pct_change"), per_asset(prices, pd.Series.pct_change))

    def test_rolling_vol(self, frame, prices, rows):
        expected = per_asset(prices, lambda s: s.rolling(16, min_periods=1).std())
        same(pull(rolling_vol(frame, BY, "row_idx", "close", 16, rows=rows), "volatility"), expected, 1e-7)

    def test_forward_return(self, frame, prices, rows):
        expected = per_asset(prices, lambda s: (s.shift(-24) - s) / s)
        same(pull(forward_return(frame, BY, "row_idx", "close", rows=rows), "forward_return"), expected)

    def test_target(self, frame, prices, rows):
        def label(s):
            r = s.pct_change()
            return ((s.shift(-24) - s) / s / (r.rolling(16, min_periods=1).std() + 1e-6)).dropna()

        got = target_score(frame, BY, "row_idx", window=16, rows=rows)
        assert got.count() == 211 + 60 - 2 * 26
        same(pull(got, "target_score"), per_asset(prices, label), 1e-6)

    def test_sma_and_lags(self, frame, prices, rows):
        same(
            pull(sma(frame, BY, "row_idx", "close", {"m": 25}, rows), "m"),
            per_asset(prices, lambda s: s.rolling(25, min_periods=1).mean()),
        )
        lagged = lag_features(frame, BY, "row_idx", ["close"], [1, 30], rows)
        same(pull(lagged, "close_lag_30"), per_asset(prices, lambda s: s.shift(30)))

    @pytest.mark.parametrize("alpha", [0.9, 0.2, 1 / 14, 0.001])
    def test_ema(self, frame, prices, rows, alpha):
        got = ema(frame, BY, "row_idx", [Ema("close", "y", alpha, 5)], rows)
        expected = per_asset(prices, lambda s: s.ewm(alpha=alpha, adjust=False, min_periods=5).mean())
        same(pull(got, "y"), expected, 1e-10)

    def test_macd(self, frame, prices, rows):
        def line(s):
            fast = s.ewm(span=12, adjust=False, min_periods=12).mean()
            return fast - s.ewm(span=26, adjust=False, min_periods=26).mean()

        got = macd(frame, BY, "row_idx", rows=rows)
        same(pull(got, "MACD"), per_asset(prices, line))
        signal = per_asset(prices, lambda s: line(s).dropna().ewm(span=9, adjust=False, min_periods=9).mean().reindex(s.index))
        same(pull(got, "MACD_signal"), signal)
        first = got.where("asset = 'BTC'").toPandas().sort_values("row_idx")
        assert first["MACD"].isna().sum() == 25 and first["MACD_signal"].isna().sum() == 33

    def test_rsi(self, frame, prices, rows):
        def wilder(s):
            d = s.diff()
            up = d.clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
            down = (-d).clip(lower=0).fillna(0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
            return pd.Series(np.where(down == 0, 100, 100 - 100 / (1 + up / down)), index=s.index).where(up.notna())

        same(pull(rsi(frame, BY, "row_idx", rows=rows), "RSI"), per_asset(prices, wilder))

    def test_indicators_agree(self, frame, rows):
        both = indicators(frame, BY, "row_idx", rows=rows).toPandas().sort_values([*BY, "row_idx"])
        same(both["RSI"], pull(rsi(frame, BY, "row_idx"), "RSI"))
        same(both["MACD_hist"], pull(macd(frame, BY, "row_idx"), "MACD_hist"))
        assert both["MA25"].notna().all()

    def test_sequence_windows(self, frame, prices, rows):
        got = sequence_windows(frame, BY, "row_idx", ["close"], "close", length=24, rows=rows)
        assert got.count() == (211 - 24) + (60 - 24)
        row = got.where("asset = 'BTC' and idx = 40").first()
        btc = prices[prices.asset == "BTC"]["close"].to_numpy()
        same(row["close"], btc[40:64])
        same([row["target"]], [btc[64]])


def test_rsi_without_losses(spark):
    rising = spark.createDataFrame([("A", i, 100.0 + i) for i in range(40)], "asset string, row_idx long, close double")
    got = rsi(rising, BY, "row_idx").toPandas().sort_values("row_idx")["RSI"]
    assert got.isna().sum() == 13 and (got.dropna() == 100).all()


def test_row_and_grid_index(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame({"k": rng.choice(["a", "a", "a", "b"], 5_000), "t": rng.integers(0, 50, 5_000), "id": np.arange(5_000)})
    expected = data.sort_values(["k", "t", "id"]).assign(i=lambda d: d.groupby("k").cumcount())
    sizes = data.groupby("k").size()
    df = spark.createDataFrame(data).repartition(7)
    got = row_index(df, ["k"], ["t", "id"], total="n").toPandas().sort_values(["k", "t", "id"])
    assert (got["row_idx"].to_numpy() == expected["i"].to_numpy()).all()
    assert (got["n"] == got["k"].map(sizes)).all()
    by_id = data.sort_values(["k", "id"]).assign(i=lambda d: d.groupby("k").cumcount())
    got = grid_index(df, ["k"], "id", total="n", rows=64).toPandas().sort_values(["k", "id"])
    assert (got["row_idx"].to_numpy() == by_id["i"].to_numpy()).all()
    assert (got["n"] == got["k"].map(sizes)).all()
    whole = row_index(df, [], ["t", "id"]).toPandas().sort_values(["t", "id"])
    assert (whole["row_idx"].to_numpy() == np.arange(5_000)).all()


def test_row_index_spreads_a_hot_key(spark):
    from tsalign.operators.chunk import arrange

    hot = spark.range(20_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    parts = arrange(hot, ["k"], ["t"]).groupBy("_part").count().toPandas()
    assert len(parts) >= 1 and parts["count"].sum() == 20_000


def test_forward_fill_and_running_min(spark):
    values = [None, None, 3.0] + [None] * 20 + [1.0, None, 2.0] + [None] * 9
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate(values)], "asset string, row_idx long, v double")
    filled = forward_fill(df, BY, "row_idx", {"v": "f"}, rows=4)
    same(pull(filled, "f"), pd.Series(values, dtype=float).ffill())
    low = running_min_before(df, BY, "row_idx", "v", "low", rows=4)
    same(pull(low, "low"), pd.Series(values, dtype=float).expanding().min().shift(1).ffill())


# --- as-of ------------------------------------------------------------------


def _times(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_asof_edges(spark):
    left = _times(spark, [("x", 0), ("x", 1), ("x", 5), ("y", 5)], "k string, on long")
    right = _times(spark, [("x", 1, 1, "a"), ("x", 1, 2, "b"), ("x", 4, 3, "c"), ("y", 6, 4, "d")], "k string, on long, seq long, v string")
    got = {(r.k, r.on): r.v for r in asof_backward(left, right, "on", ["k"], ["v"], ["seq"]).collect()}
    assert got == {("x", 0): None, ("x", 1): "b", ("x", 5): "c", ("y", 5): None}


def test_asof_takes_a_null_value_of_the_matched_row(spark):
    left = _times(spark, [(3,)], "on long")
    right = _times(spark, [(1, 10.0), (2, None)], "on long, v double")
    assert asof_backward(left, right, "on", [], ["v"]).first().v is None


def test_asof_jitter(spark):
    left = _times(spark, [("08:00:00",), ("09:00:00",)], "t string").select(F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("on"))
    right = _times(spark, [("00:00:00.000", 1.0), ("08:00:00.008", 2.0)], "t string, rate double").select(
        F.to_timestamp(F.concat(F.lit("2024-01-01 "), "t")).alias("on"), "rate"
    )
    got = [r.rate for r in asof_backward(left, right, "on", [], ["rate"]).orderBy("on").collect()]
    assert got == [1.0, 2.0]


def test_asof_clips_per_key(spark):
    left = _times(spark, [("a", 10), ("a", 20), ("b", 20)], "asset string, on long")
    right = _times(spark, [(5, 1.0), (12, 2.0)], "on long, v double")
    got = {(r.asset, r.on): r.v for r in asof_backward(left, right, "on", [], ["v"], clip_by=["asset"]).collect()}
    assert got == {("a", 10): None, ("a", 20): 2.0, ("b", 20): None}
    whole = {(r.asset, r.on): r.v for r in asof_backward(left, right, "on", [], ["v"], clip_by=[]).collect()}
    assert whole == {("a", 10): None, ("a", 20): 2.0, ("b", 20): 2.0}
    assert [r.on for r in clip_to_range_of(right, left, "on").collect()] == [12]


def test_asof_against_pandas(spark):
    rng = np.random.default_rng(11)
    left = pd.DataFrame({"k": rng.choice(list("aaab"), 4_000), "t": rng.integers(0, 10_000, 4_000), "id": np.arange(4_000)})
    right = pd.DataFrame({"k": rng.choice(list("ab"), 600), "t": rng.integers(0, 10_000, 600), "v": np.arange(600.0), "seq": np.arange(600)})
    expected = pd.merge_asof(left.sort_values("t", kind="stable"), right.sort_values("t", kind="stable"), on="t", by="k").sort_values("id")
    got = asof_backward(spark.createDataFrame(left).repartition(9), spark.createDataFrame(right).repartition(3), "t", ["k"], ["v"], ["seq"])
    same(got.toPandas().sort_values("id")["v"], expected["v"])


# --- label edges ------------------------------------------------------------


def test_null_and_zero_closes(spark):
    df = spark.createDataFrame([("A", i, v) for i, v in enumerate([100.0, None, 110.0, 0.0, 5.0])], "asset string, row_idx long, close double")
    got = pct_change(df, BY, "row_idx", "close").toPandas().sort_values("row_idx")["pct_change"].tolist()
    assert np.isnan(got[0]) and got[1] == 0 and got[2] == pytest.approx(0.1) and got[3] == -1 and np.isnan(got[4])
    steps = return_1h(df, BY, "row_idx").toPandas().sort_values("row_idx")["return_1h"].tolist()
    assert steps[0] == 0 and steps[4] == 0
    loose = pct_change(df, BY, "row_idx", "close", pad=False).toPandas().sort_values("row_idx")["pct_change"].tolist()
    assert np.isnan(loose[1]) and np.isnan(loose[2])


@pytest.mark.parametrize("window", [1, 2, 5, 16, 300])
def test_rolling_vol_with_holes_and_jumps(spark, window):
    rng = np.random.default_rng(window)
    x = rng.normal(size=150) * np.where(rng.random(150) < 0.1, 1e6, 1e-3)
    x[rng.random(150) < 0.2] = np.nan
    x[60:90] = 0.1
    df = spark.createDataFrame([("A", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "asset string, row_idx long, x double")
    got = pull(rolling_vol(df, BY, "row_idx", "x", window, rows=32), "volatility")
    expected = np.array([pd.Series(x[max(0, i - window + 1) : i + 1]).std() for i in range(150)])
    same(got, expected, 1e-9)
    if window == 5:
        assert set(got[64:90]) == {0.0}


def test_warm_up_and_tail(spark):
    df = spark.createDataFrame([("A", i, 100.0 + i) for i in range(40)], "asset string, row_idx long, close double")
    kept = [r.row_idx for r in target_score(df, BY, "row_idx").orderBy("row_idx").collect()]
    assert kept == list(range(2, 16))
    bounded = target_score(df, BY, "row_idx", mode="tanh").toPandas()["target_score"]
    assert bounded.between(-100, 100).all()
    with pytest.raises(ValueError):
        target_score(df, BY, "row_idx", mode="other")


# --- split, batches, samples ------------------------------------------------


@pytest.mark.parametrize("n,sizes", [(90, (62, 24, 4, 0, 0)), (44_477, (31_133, 24, 6_671, 24, 6_625))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.lit("A").alias("asset"), (F.col("id") + 1_000).alias("hour"))
    got = {r.split: r["count"] for r in chronological_split(df, BY, "hour", rows=1_000).groupBy("split").count().collect()}
    names = ("train", "embargo_1", "validation", "embargo_2", "test_in_domain")
    assert tuple(got.get(s, 0) for s in names) == sizes


def test_batches(spark):
    df = spark.range(10).withColumnRenamed("id", "i")
    assert batches(df, "i", 4).groupBy("batch_idx").count().orderBy("batch_idx").toPandas()["count"].tolist() == [4, 4, 2]
    full = batches(df, "i", 4, drop_last=True, seed=1)
    assert full.groupBy("batch_idx").count().toPandas()["count"].tolist() == [4, 4]
    again = batches(df, "i", 4, drop_last=True, seed=1)
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, again.collect()))


@pytest.mark.parametrize("n,m", [(1_000, 100), (250, 100), (100, 100), (7, 100), (1, 100), (999, 7), (5, 1)])
def test_sample_positions(spark, n, m):
    got = sorted(r.sample_pos for r in sample_positions(spark.range(n), "id", m).collect())
    size = min(n, m)
    assert got == sorted(set(np.linspace(0, n - 1, size, dtype=int).tolist()))


# --- windows ----------------------------------------------------------------


def test_candle_window_minimum(spark):
    df = spark.createDataFrame([("A", i, float(i)) for i in range(30)], "asset string, row_idx long, close double")
    got = candle_windows(df, BY, "row_idx", ["close"], rows=5).toPandas()
    assert len(got) == 19 and got["candles"].map(len).max() == 24 and got["candles"].map(len).min() == 12
    first = [c.close for c in candle_windows(df, BY, "row_idx", ["close"], rows=5).orderBy("row_idx").first().candles]
    assert first == [float(i) for i in range(12)]


def test_windows_across_the_seam(spark):
    rows = [("BTC", i, i, float(i)) for i in range(3)] + [("ETH", i, i + 3, float(i + 10)) for i in range(3)]
    df = spark.createDataFrame(rows, "asset string, row_idx long, whole long, x double")
    apart = sequence_windows(df, BY, "row_idx", ["x"], "x", length=2)
    assert sorted(map(tuple, (r.x for r in apart.collect()))) == [(0.0, 1.0), (10.0, 11.0)]
    across = sequence_windows(df, [], "whole", ["x"], "x", length=2)
    assert across.count() == 4
    assert [r.asset for r in short_series(df, BY, 3).orderBy("asset").collect()] == ["BTC", "ETH"]


def test_flatten_window(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0]],)], "w array<array<double>>")
    assert flatten_window(df, "w", "v").first().v == [1.0, 2.0, 3.0]


def test_gaps_and_nulls(spark):
    hours = [0, 1, 4, 5]
    df = spark.createDataFrame([("A", i, h, None if i in (1, 3) else 1.0) for i, h in enumerate(hours)], "asset string, row_idx long, h long, v double")
    df = df.withColumn("timestamp", F.timestamp_seconds(F.col("h") * 3600))
    assert [(r.row_idx, r.gap_hours) for r in gap_check(df, BY, "row_idx", rows=2).collect()] == [(2, 3.0)]
    assert sorted(r.row_idx for r in null_context(df, BY, "row_idx", "v", 1).collect()) == [0, 1, 2]
    assert sorted(r.row_idx for r in null_context(df, [], "row_idx", "v", 1).collect()) == [0, 1, 2]
    assert [r.row_idx for r in null_positions(df, BY, "row_idx", "v", 1).collect()] == [1]


def test_keep_last_n(spark):
    df = spark.createDataFrame([("r", e) for e in (10, 20, 30, 40)], "run string, epoch long")
    kept = keep_last_n(df, ["run"], "epoch", 3).where("keep").toPandas()["epoch"]
    assert sorted(kept) == [20, 30, 40]
