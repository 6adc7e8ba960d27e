"""Texts, functions, quality, scaling, metrics and features on hand-made rows."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsalign.functions.classes import fear_greed_class, ratio_class, sentiment_class, significance_stars, tone_class
from tsalign.functions.text import asset_list, clean_text, combine_news_text, combine_post_text, text_hash, token_count
from tsalign.functions.time import floor_hour, from_millis, parse_iso, to_numeric
from tsalign.operators.dedupe import dedupe_by_text_hash, dedupe_keep_first, dedupe_on_first_key, random_sample, removed_rows
from tsalign.operators.features import HashedTokens, embed_column, encoder_of, format_prompt, project_vectors, tabular_baseline, xavier_uniform
from tsalign.operators.filters import final_projection, require_columns
from tsalign.operators.joins import compare_to_claims, left_join_on_time, modality_counts_match
from tsalign.operators.metrics import batch_mean_metrics, best_epoch, regression_metrics
from tsalign.operators.profile import (
    boxplot_stats,
    embargo_check,
    histogram,
    image_sample_report,
    moments,
    outlier_counts,
    t_p_value,
    target_profile,
    ttest_ind,
)
from tsalign.operators.quantile import quantiles
from tsalign.operators.scale import apply_scaler, fit_robust, fit_standard
from tsalign.operators.texts import grouped_text, hourly_text, text_coverage
from tsalign.operators.validate import batch_ok, validate_fear_greed, validate_news, validate_posts, violation_counts
from tsalign.operators.windows import running_best


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_text(spark):
    raw = ["a http://x.y/z next", "see https://a.b tail", "x\x1cy", "rocket\U0001f680ship", "www.q.com !", None, " \t\n"]
    assert column(spark, raw, "string", clean_text) == ["a next", "see tail", "x y", "rocketship", "!", "", ""]


def test_assets(spark):
    raw = ["BTC and Ethereum", "ethics", "bitcoins", "eth, btc"]
    assert column(spark, raw, "string", asset_list) == ["BTC,ETH", "OTHER", "OTHER", "BTC,ETH"]


def test_hash_tokens_and_combining(spark):
    assert column(spark, ["AbC"], "string", text_hash) == [hashlib.sha256(b"abc").hexdigest()]
    assert column(spark, ["", "  ", "a  b\nc"], "string", token_count) == [0, 0, 3]
    df = spark.createDataFrame([("t", None), (None, "b"), (None, None)], "a string, b string")
    rows = df.select(combine_post_text(F.col("a"), F.col("b")), combine_news_text(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [("t", "t "), ("b", " b"), ("", " ")]


def test_parsing(spark):
    assert column(spark, ["1.5", "x", "1d", "2f", "1e3", None, "nan"], "string", to_numeric) == [1.5, None, None, None, 1000.0, None, None]
    seconds = lambda c: F.unix_millis(c)
    assert column(spark, ["1672560000008", "bad"], "string", lambda c: seconds(from_millis(c))) == [1672560000008, None]
    assert column(spark, ["2023-01-01T00:00:00+00:00", "2023-01-01 00:00:00", "?"], "string", lambda c: seconds(parse_iso(c))) == [1672531200000, 1672531200000, None]
    default = F.lit("2024-01-01 05:30:00").cast("timestamp")
    got = column(spark, ["2023-01-01 07:59:59", None], "string", lambda c: F.date_format(floor_hour(c.cast("timestamp"), default), "yyyy-MM-dd HH"))
    assert got == ["2023-01-01 07", "2024-01-01 05"]


def test_classes(spark):
    assert column(spark, [25, 46, 54, 75, 100, 0, None], "int", fear_greed_class) == ["Fear", "Neutral", "Greed", "Extreme Greed", "Extreme Greed", "Extreme Fear", None]
    assert column(spark, [-20.0, 0.0, 20.0, None], "double", sentiment_class) == ["Bearish", "Neutral", "Bullish", None]
    assert column(spark, [3.5, 3.0, 1.5, 1.0, 0.9], "double", ratio_class) == ["Extremely bullish", "Moderately bullish", "Moderately bullish", "Neutral to slightly bullish", "Bearish"]
    assert column(spark, [-60.0, -50.0, -10.0, 10.0, 50.0], "double", tone_class) == ["Very negative", "Negative", "Neutral", "Positive", "Very positive"]
    assert column(spark, [0.0001, 0.005, 0.02, 0.5, None], "double", significance_stars) == ["***", "**", "*", "ns", None]


# --- texts ------------------------------------------------------------------


def test_hourly_text(spark):
    rows = [("2024-01-01 10:50:00", "late", 1), ("2024-01-01 10:10:00", "early", 2), ("2024-01-01 10:20:00", None, 3), ("2024-01-01 11:00:00", None, 4)]
    df = spark.createDataFrame(rows, "t string, text string, seq long").withColumn("ts", F.to_timestamp("t"))
    got = {r.hour: r.text_content for r in hourly_text(df, "ts", "text", ["seq"]).select(F.date_format("timestamp", "HH").alias("hour"), "text_content").collect()}
    assert got == {"10": "late [SEP] early", "11": ""}


def test_grouped_text_over_many_runs(spark):
    n = 10_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") % 3).alias("file"), "id", F.col("id").cast("string").alias("t")).repartition(6)
    got = grouped_text(df, ["k"], "t", ["file", "id"]).first().text_content.split(" [SEP] ")
    assert got == [str(i) for f in range(3) for i in range(f, n, 3)]


def test_text_coverage(spark):
    df = spark.createDataFrame([("[NO_EVENT] market is quiet",), ("abc NOT",), ("abc",), (None,)], "t string")
    strict, loose = text_coverage(df, "t").first(), text_coverage(df, "t", regex_compat=True).first()
    assert (strict.no_event, strict.real, strict.no_event_pct) == (1, 3, 25.0)
    assert loose.no_event == 2


def test_duplicate_right_stamp_repeats_the_left_row(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "timestamp long, x string")
    right = spark.createDataFrame([(1, 5), (1, 6)], "timestamp long, y long")
    assert left_join_on_time(left, right).count() == 3


# --- dedupe -----------------------------------------------------------------


def test_dedupe(spark):
    df = spark.createDataFrame([(3, "A", "z"), (1, "b", "x"), (2, "a", "y"), (4, None, "n"), (5, None, "m")], "seq long, title string, body string")
    kept = dedupe_by_text_hash(df, "title", ["seq"])
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 4]
    assert sorted(r.seq for r in dedupe_on_first_key(df, ["seq"]).collect()) == [1, 2, 3, 4]
    assert dedupe_on_first_key(df.drop("title"), ["seq"]).count() == 5
    assert removed_rows(df, ["title"]).first().removed == 1
    same = spark.createDataFrame([("k", i) for i in range(2_000)], "k string, seq long").repartition(8)
    assert [tuple(r) for r in dedupe_keep_first(same, ["k"], ["seq"]).collect()] == [("k", 0)]
    pick = lambda: [r.seq for r in random_sample(same, 5, "seq", 1).collect()]
    assert pick() == pick()


# --- profiles ---------------------------------------------------------------


def test_quantiles_and_moments(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "x double")
    q = target_profile(df, ["x"]).first()
    assert (q.q1, q.median, q.q3) == (1.75, 3.0, 5.5)
    m = moments(df, ["x"]).first()
    assert m.skewness == pytest.approx(0.848321, abs=1e-6) and m.kurtosis == pytest.approx(-0.929231, abs=1e-6)
    assert moments(spark.createDataFrame([(1.0,)] * 3, "x double"), ["x"]).first().skewness is None


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"g": rng.choice(list("ab"), 6_000), "x": np.where(rng.random(6_000) < 0.4, 0.0, rng.normal(size=6_000))})
    got = {(r.g): (r.p1, r.p50, r.p99) for r in quantiles(spark.createDataFrame(data).repartition(7), ["g"], ["x"], {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
    for g, part in data.groupby("g"):
        np.testing.assert_allclose(got[g], part["x"].quantile([0.01, 0.5, 0.99]), rtol=1e-12)


def test_histogram_boxplot_outliers(spark):
    values = [float(v) for v in range(20)] + [1_000.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    h = histogram(df, ["x"], 10).toPandas().sort_values("bin")
    assert h["n"].tolist() == [20] + [0] * 8 + [1]
    flat = histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), ["x"], 10).toPandas()
    assert flat["n"].sum() == 3 and len(flat) == 10
    b = boxplot_stats(df, ["x"]).first()
    assert (b.q1, b.median, b.q3, b.whisker_low, b.whisker_high) == (5.0, 10.0, 15.0, 0.0, 19.0)
    o = outlier_counts(df, ["x"]).first()
    assert (o.iqr_outliers, o.z_outliers) == (1, 1)


def test_ttest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 2.0), ("b", 4.0), ("b", 9.0)], "g string, x double")
    t = ttest_ind(df, "g", "a", "b", ["x"]).first()
    assert t.t_stat == pytest.approx(-3 / math.sqrt(7 * 2 / 3)) and t.diff_pct == 150.0 and t.stars == "ns"
    # Table values of Student's t.
    assert t_p_value(2.776445, 4) == pytest.approx(0.05, abs=1e-6)
    assert t_p_value(12.7062, 1) == pytest.approx(0.05, abs=1e-6)
    assert t_p_value(1.959964, 1e7) == pytest.approx(0.05, abs=1e-5)
    assert t_p_value(0.0, 10) == pytest.approx(1.0)


def test_embargo_check(spark):
    df = spark.createDataFrame([("train", 0), ("validation", 24), ("validation", 30), ("test_in_domain", 53)], "split string, h long")
    r = embargo_check(df.withColumn("timestamp", F.timestamp_seconds(F.col("h") * 3600))).first()
    assert (r.embargo_1_ok, r.embargo_2_ok, r.ordered) == (True, False, True)


def test_image_report(spark):
    df = spark.createDataFrame([("a", 224, 224), ("b", 224, 224), ("c", 10, 10), (None, None, None)], "path string, w int, h int")
    r = image_sample_report(df, "path", "w", "h").first()
    assert (r.valid, r.invalid, r.resolutions, r.dominant, r.coverage_pct) == (3, 1, 2, "224x224", 75.0)


def test_claims_and_projection(spark):
    actual = spark.createDataFrame([("x", 1.0), ("y", 2.0)], "k string, actual double")
    claims = spark.createDataFrame([("x", 1.005)], "k string, claimed double")
    assert {r.k: r.ok for r in compare_to_claims(actual, claims, ["k"]).collect()} == {"x": True, "y": False}
    kept, missing = final_projection(actual, ["actual", "z", "k"])
    assert kept.columns == ["actual", "k"] and missing == ["z"]
    with pytest.raises(ValueError):
        require_columns(actual, ["nope"])


def test_modality_counts(spark):
    two = spark.range(2).select(F.lit("A").alias("asset"), F.lit("train").alias("split"))
    assert modality_counts_match([two, two]).first().equal
    assert not modality_counts_match([two, two.limit(1)]).first().equal


# --- validation -------------------------------------------------------------


def test_validation(spark):
    rows = [("50", "Neutral", 1), ("101", "?", 1), ("x", "?", 1), (None, "?", 1)]
    df = validate_fear_greed(spark.createDataFrame(rows, "value string, value_classification string, timestamp long"))
    assert {r.violation: r.n for r in violation_counts(df).collect()} == {"ok": 1, "out_of_range": 1, "not_integer": 1, "missing_field": 1}
    assert batch_ok(df.limit(0)).first().batch_ok and not batch_ok(df).first().batch_ok
    posts = spark.createDataFrame([("2024-01-01T00:00:00", "t"), ("bad", "t"), ("2024-01-01", " ")], "timestamp string, combined_text string")
    judged = validate_posts(posts, required=[])
    assert [r.violation for r in judged.collect()] == [None, "bad_timestamp", "blank_text"]
    news = spark.createDataFrame([(1, None), (None, None)], "a long, b string")
    assert [r.violation for r in validate_news(news).collect()] == [None, "empty_record"]


# --- scaling and metrics ----------------------------------------------------


def test_constant_feature(spark):
    df = spark.createDataFrame([("a", 5.0)] * 3 + [("b", 1.0), ("b", 3.0)], "g string, x double")
    only = df.where("g = 'a'")
    for fit in (fit_standard, fit_robust):
        stats = fit(only, ["x"]).first()
        assert stats.x_scale == 1.0
        assert {r.x_scaled for r in apply_scaler(only, fit(only, ["x"]), ["x"]).collect()} == {0.0}
    got = apply_scaler(df, fit_standard(df, ["x"], ["g"]), ["x"], ["g"])
    assert sorted(r.x_scaled for r in got.collect()) == [-1.0, 0.0, 0.0, 0.0, 1.0]


def test_metrics(spark):
    rows = [(0, 1.0, 2.0), (1, 2.0, 2.0), (2, 3.0, 5.0), (3, 4.0, 3.0), (4, 9.0, 5.0)]
    df = spark.createDataFrame(rows, "idx long, prediction double, target double").withColumn("batch", F.floor(F.col("idx") / 2))
    m, b = regression_metrics(df).first(), batch_mean_metrics(df, "batch").first()
    p, t = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert m.mse == pytest.approx(((p - t) ** 2).mean())
    assert m.r2 == pytest.approx(1 - ((p - t) ** 2).sum() / ((t - t.mean()) ** 2).sum())
    assert m.correlation == pytest.approx(np.corrcoef(p, t)[0, 1])
    assert m.error_std == pytest.approx((p - t).std(ddof=1))
    assert b.mse_batch_mean == pytest.approx((0.5 + 2.5 + 16) / 3) and b.mse_batch_mean != m.mse
    assert batch_mean_metrics(df, "batch", size=2).first().batches == 2
    flat = regression_metrics(df.withColumn("target", F.lit(2.0))).first()
    assert flat.r2 == 0.0 and flat.correlation == 0.0


def test_histories(spark):
    df = spark.createDataFrame([("r", e, v) for e, v in [(1, 3.0), (2, 2.0), (3, 1.0), (4, 1.5), (5, 1.0)]], "run string, epoch long, val_mse double")
    assert best_epoch(df).first().best_epoch == 3
    got = running_best(df.withColumn("at", F.col("epoch") - 1), ["run"], "at", rows=2).toPandas().sort_values("epoch")
    assert got["improved"].tolist() == [True, True, True, False, False]


# --- features ---------------------------------------------------------------


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, "x " * 50 + "tail"), (4, None)], "i long, t string")
    got = {r.i: r.v for r in embed_column(df, "t", "v", encoder_of(16), batch=2).collect()}
    assert all(len(v) == 16 for v in got.values()) and got[1] == pytest.approx(got[2]) and set(got[4]) == {0.0}
    whole, cut = HashedTokens(16), HashedTokens(16, max_tokens=50)
    text = "x " * 50 + "tail"
    np.testing.assert_allclose(got[3], whole([text])[0], rtol=1e-5)
    assert not np.allclose(whole([text]), cut([text]))


def test_projection(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 2.0],)], "v array<float>")
    m = xavier_uniform(2, 3, 42)
    got = [r.p for r in project_vectors(df, "v", "p", 2, 3).collect()]
    np.testing.assert_allclose(got, [m[0], 2 * m[1]], rtol=1e-6)
    assert np.abs(m).max() <= math.sqrt(6 / 5)


@pytest.mark.parametrize("kind", ["linear", "trees"])
def test_baseline(spark, kind):
    df = spark.range(200).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0 + 1).alias("y"))
    got = tabular_baseline(df, df, ["x"], "y", kind)
    assert regression_metrics(got, target="y").first().r2 > (0.999 if kind == "linear" else 0.9)


def test_trees_read_rows_of_equal_features_once(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    n = F.col("id")
    df = spark.range(9000).select((n * n % 23).cast("double").alias("a"), (n % 7).cast("double").alias("b"), (n * 37 % 1009).cast("double").alias("e"))
    df = df.withColumn("y", F.col("a") * 10 - F.col("b") * F.col("a") + F.col("e") / 100)
    # as many rows as the plain fit reads without a sample
    plain = GBTRegressor(featuresCol="x", labelCol="y", maxIter=20, seed=42).fit(df.withColumn("x", array_to_vector(F.array("a", "b"))))
    want = {(r.a, r.b): r.prediction for r in plain.transform(df.withColumn("x", array_to_vector(F.array("a", "b")))).collect()}
    read, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, rows: read.append(rows.count()) or fit(self, rows))
    got = tabular_baseline(df, df, ["a", "b"], "y", "trees").collect()
    assert len(got) == 9000 and read == [len(want)]
    np.testing.assert_allclose([r.prediction for r in got], [want[r.a, r.b] for r in got], rtol=1e-9)
    with pytest.raises(Exception, match="(?i)null"):
        tabular_baseline(df.withColumn("y", F.when(F.col("e") != 1, F.col("y"))), df, ["a", "b"], "y", "trees")


def test_trees_do_not_depend_on_the_partitions(spark):
    n = F.col("id")
    df = spark.range(30000).select((n * n % 211).cast("double").alias("a"), (n * n * n % 1009).cast("double").alias("y"))
    a, b = ({r.a: r.prediction for r in tabular_baseline(df.repartition(k), df, ["a"], "y", "trees").collect()} for k in (3, 7))
    assert a.keys() == b.keys()
    np.testing.assert_allclose([a[k] for k in a], [b[k] for k in a], rtol=1e-9)


def test_prompt(spark):
    row = (0.5, 1234567.0, 0.0001, 40, 3, -1.5, 2, "n" * 600, 12.34)
    df = spark.createDataFrame([row], "return_1h double, volume double, funding_rate double, fear_greed_value int, gdelt_econ_volume long, gdelt_econ_tone double, gdelt_conflict_volume long, text_content string, target_score double")
    text = df.select(format_prompt(500)).first().prompt
    assert "- Price return (1h): 0.50%\n- Volume: 1,234,567\n- Funding rate: 0.0001\n- Fear/Greed: 40/100" in text
    assert "n" * 500 in text and "n" * 501 not in text and text.endswith("Answer: 12.3")
    assert "n" * 600 in df.select(format_prompt()).first().prompt
