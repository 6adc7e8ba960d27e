"""NULL keys, positions and values, and sides that are missing."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsalign.operators.chunk import forward_fill, grid_index, row_index, running_min_before
from tsalign.operators.indicators import Ema, ema
from tsalign.operators.joins import compare_to_claims, zip_modalities
from tsalign.operators.profile import boxplot_stats, histogram, outlier_counts, t_p_value, target_profile
from tsalign.operators.split import chronological_split
from tsalign.operators.windows import null_positions, sequence_windows
from tsalign.sources import files


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_indices_keep_null_keys_and_positions(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 7), (None, 5)], "asset string, pos bigint")
    assert rows(grid_index(df, ["asset"], "pos")) == rows(
        spark.createDataFrame([("a", 1, 0), ("a", None, None), (None, 7, 1), (None, 5, 0)], "a string, b bigint, c bigint")
    )
    assert rows(row_index(df, ["asset"], ["pos"], total="n").select("asset", "pos", "row_idx", "n")) == sorted(
        [("a", None, 0, 2), ("a", 1, 1, 2), (None, 5, 0, 2), (None, 7, 1, 2)], key=str
    )


def test_prefixes_carry_over_null_keys(spark):
    df = spark.createDataFrame([(None, i, float(i) if i in (0, 7) else None) for i in range(10)], "k string, p bigint, v double")
    filled = {r.p: r.f for r in forward_fill(df, ["k"], "p", {"v": "f"}, rows=3).collect()}
    assert filled == {i: 0.0 if i < 7 else 7.0 for i in range(10)}
    low = {r.p: r.m for r in running_min_before(df, ["k"], "p", "v", "m", rows=3).collect()}
    assert low == {i: None if i == 0 else 0.0 for i in range(10)}


def test_a_row_without_position_has_no_split(spark):
    df = spark.createDataFrame([("a", i) for i in range(200)] + [("a", None)], "asset string, hour bigint")
    out = chronological_split(df, ["asset"], "hour")
    assert out.where("split IS NULL").count() == 1 and out.count() == 201


@pytest.mark.parametrize("alpha", [0.5, 2 / 13, 0.9])
def test_ema_over_holes_is_ewm(spark, alpha):
    rng = np.random.default_rng(3)
    x = rng.normal(size=600)
    x[rng.random(600) < 0.3] = np.nan
    x[100:380] = np.nan
    x[:4] = np.nan
    df = spark.createDataFrame([("a", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)], "k string, p bigint, v double")
    out = ema(df, ["k"], "p", [Ema("v", "y", alpha, 5)], rows=64, holes=True).orderBy("p").collect()
    want = pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=5).mean()
    for r, w in zip(out, want):
        assert (r.y is None) == bool(np.isnan(w)) and (r.y is None or math.isclose(r.y, w, rel_tol=1e-9, abs_tol=1e-12))


def test_ema_of_the_probe(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 10.0, 11.0, None, 12.0, 13.0])], "k string, p bigint, v double")
    out = ema(df, ["k"], "p", [Ema("v", "y", 0.5)], holes=True).orderBy("p").collect()
    assert [r.y for r in out] == [None, 10.0, 10.5, 10.5, 11.5, 12.25]
    with pytest.raises(Exception, match="holes=True"):
        ema(df, ["k"], "p", [Ema("v", "y", 0.5)]).collect()


def test_windows_keep_their_length(spark):
    df = spark.createDataFrame([("a", i, None if i % 3 == 0 else float(i), i) for i in range(9)], "k string, p bigint, v double, w int")
    out = sequence_windows(df, ["k"], "p", ["v", "w"], "w", length=4).collect()
    assert len(out) == 5
    for r in out:
        assert r.w == list(range(r.idx, r.idx + 4)) and r.v == [None if i % 3 == 0 else float(i) for i in r.w]


def test_profiles_keep_null_groups_and_empty_features(spark):
    df = spark.createDataFrame([(None, 1.0, None), (None, 3.0, None), ("a", 2.0, None)], "g string, x double, y double")
    got = {(r.g, r.feature): (r.n, r.median) for r in target_profile(df, ["x", "y"], ["g"]).collect()}
    assert got == {(None, "x"): (2, 2.0), ("a", "x"): (1, 2.0), (None, "y"): (0, None), ("a", "y"): (0, None)}
    assert boxplot_stats(df, ["x", "y"], ["g"]).count() == 4
    assert {(r.g, r.feature): r.iqr_outliers for r in outlier_counts(df, ["x", "y"], ["g"]).collect()} == dict.fromkeys(got, 0)
    bins = histogram(df, ["x", "y"], 4, ["g"])
    assert {r.g: r.n for r in bins.groupBy("g").agg(F.sum("n").alias("n")).collect()} == {None: 2, "a": 1}


def test_modalities_and_claims_lose_nothing(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(2, "z"), (3, "w")], "k int, b string")
    assert rows(zip_modalities([a, b], ["k"], missing="null")) == [(1, "x", None), (2, "y", "z"), (3, None, "w")]
    with pytest.raises(Exception, match="lacks row"):
        zip_modalities([a, b], ["k"]).collect()
    actual = spark.createDataFrame([("n", 1.0)], "k string, actual double")
    claims = spark.createDataFrame([("n", 1.0), ("gone", 2.0)], "k string, claimed double")
    assert {r.k: r.ok for r in compare_to_claims(actual, claims, ["k"]).collect()} == {"n": True, "gone": False}


def test_defaults_take_all(spark):
    df = spark.createDataFrame([("a", i, None) for i in range(50)], "k string, p bigint, v double")
    assert null_positions(df, ["k"], "p", "v").count() == 50
    assert null_positions(df, ["k"], "p", "v", 3).count() == 3


def test_months_that_are_all_absent(spark, tmp_path):
    out = files.read_monthly(spark, str(tmp_path), "BTC-1h-", "2023-01-31", "2023-04-01")
    assert out.columns == ["timestamp", "open", "high", "low", "close", "volume"] and out.count() == 0


@pytest.mark.parametrize("t", [0.5, 2.0, 4.0])
def test_p_value_of_many_rows(t):
    assert math.isclose(t_p_value(t, 1e12), math.erfc(t / math.sqrt(2)), rel_tol=1e-8)
    assert math.isclose(t_p_value(t, 9_999.0), t_p_value(t, 10_001.0), rel_tol=3e-3)
