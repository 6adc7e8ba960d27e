"""Landed files, sinks and the whole pipelines."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsalign.operators.durable import durable, scratch_folder
from tsalign.plans.align import Sources, align, folder_sources, published
from tsalign.plans.charts import chart_windows
from tsalign.plans.verify import verify_dataset
from tsalign.sources import files, sinks


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def stamps(df, col="timestamp"):
    return [r.s for r in df.select(F.date_format(col, "yyyy-MM-dd HH:mm:ss").alias("s")).collect()]


# --- readers ----------------------------------------------------------------


def test_read_klines(spark, tmp_path):
    body = "2023-01-01 01:00:00,101.5,109.25,99.75,104.5,12.5\n2023-01-01 00:00:00,100.0,102.0,98.5,101.25,20.0\n"
    path = put(tmp_path / "k.csv", "timestamp,open,high,low,close,volume\n" + body)
    df = files.read_klines(spark, path)
    assert stamps(df) == ["2023-01-01 00:00:00", "2023-01-01 01:00:00"] and df.first().close == 101.25
    other = put(tmp_path / "d.csv", "datetime,timestamp,open,high,low,close,volume\n2023-01-01 02:00:00,junk,1,2,3,4,x\n")
    df = files.read_klines(spark, other, for_indicators=True)
    assert stamps(df) == ["2023-01-01 02:00:00"] and df.first().volume is None
    with pytest.raises(ValueError):
        files.read_klines(spark, put(tmp_path / "e.csv", "a,b\n1,2\n"))


def test_headerless_month_keeps_its_first_bar(spark, tmp_path):
    rest = ",0,0,0,0,0,0\n"
    put(tmp_path / "BTC-1h-2023-01.csv", f"1672531200000,1,2,0.5,1.5,9{rest}1672534800000,1,2,0.5,1.6,9{rest}")
    put(tmp_path / "BTC-1h-2023-03.csv", f"open_time,open,high,low,close,volume,c,q,n,t,u,i\n1677628800000,1,2,0.5,bad,9{rest}1672534800000,1,2,0.5,7.7,9{rest}")
    df = files.read_monthly(spark, str(tmp_path), "BTC-1h-", "2023-01-01", "2023-04-01")
    assert stamps(df) == ["2023-01-01 00:00:00", "2023-01-01 01:00:00", "2023-03-01 00:00:00"]
    assert [r.close for r in df.collect()] == [1.5, 1.6, None]


def test_read_funding_keeps_jitter(spark, tmp_path):
    path = put(tmp_path / "f.csv", "calc_time,funding_interval_hours,last_funding_rate\n1700000000000,8,0.25\n1700028800007,8,0.5\n")
    got = files.read_funding(spark, path).select(F.unix_millis("timestamp").alias("ms"), "funding_rate").collect()
    assert [tuple(r) for r in got] == [(1700000000000, 0.25), (1700028800007, 0.5)]


def test_read_fear_greed(spark, tmp_path):
    payload = {"data": [{"timestamp": "1517529600", "value": "15", "value_classification": "Extreme Fear"}, {"timestamp": "1517443200", "value": "30"}, {"value": "1"}]}
    path = put(tmp_path / "fg.json", json.dumps(payload, indent=1))
    rows = files.read_fear_greed_json(spark, path).collect()
    assert [(r.timestamp, r.value, r.value_classification) for r in rows] == [(0, 1, "Unknown"), (1517443200, 30, "Unknown"), (1517529600, 15, "Extreme Fear")]
    assert rows[0].datetime is None
    assert files.read_fear_greed_json(spark, path, "2018-02-01", "2018-02-01").count() == 1
    with pytest.raises(Exception, match="no data field"):
        files.read_fear_greed_json(spark, put(tmp_path / "bad.json", "{}")).collect()
    csv = put(tmp_path / "fg.csv", "timestamp,datetime,value,value_classification,time_until_update,source\n1517443200,2018-02-01T00:00:00+00:00,30,Fear,,x\n")
    df = files.read_fear_greed(spark, csv)
    assert stamps(df) == ["2018-02-01 00:00:00"] and df.first().fear_greed_value == 30


def test_read_macro(spark, tmp_path):
    path = put(tmp_path / "m.csv", "timestamp,gdelt_econ_volume,gdelt_econ_tone,gdelt_conflict_volume\n2022-06-05T04:00:00+00:00,17,2.5,4\n2022-06-05T05:00:00+00:00,,,\n")
    rows = [tuple(r)[1:] for r in files.read_macro(spark, path).orderBy("timestamp").collect()]
    assert rows == [(17, 2.5, 4), (0, 0.0, 0)]


def test_read_news(spark, tmp_path):
    path = put(tmp_path / "n.csv", 'published_on,title,body,url\n2023-01-01 10:50:00,A,"two\nlines ""quoted""",u\n2023-01-01 10:10:00,B,,u\n')
    rows = files.read_news(spark, path).orderBy(*files.FILE_ORDER).collect()
    assert [r.text_content for r in rows] == ['A two\nlines "quoted"', "B "]
    path = put(tmp_path / "c.csv", "published_on,combined_text\n2023-01-01 10:50:00,\n")
    assert files.read_news(spark, path).first().text_content is None


def test_read_posts(spark, tmp_path):
    post = lambda **k: {"data": {"title": "", "selftext": "", "created_utc": 1672534805.0, **k}}
    listing = {"data": {"after": None, "children": [post(title="BTC up", score=3), post(title="\U0001f680"), post(selftext="no stamp", created_utc=None)]}}
    path = put(tmp_path / "p.json", json.dumps(listing))
    rows = files.read_posts_json(spark, path, "Bitcoin").orderBy("combined_text").collect()
    assert [(r.combined_text, r.assets, r.score) for r in rows] == [("BTC up", "BTC", 3), ("no stamp", "OTHER", 0)]
    assert rows[1].timestamp is None and len(rows[0].text_hash) == 64
    default = F.lit("2024-01-01 05:30:00").cast("timestamp")
    filled = files.read_posts_json(spark, path, "Bitcoin", default).where("combined_text = 'no stamp'")
    assert stamps(filled) == ["2024-01-01 05:00:00"]


def test_read_perp_metrics(spark, tmp_path):
    path = put(tmp_path / "l.csv", "timestamp,asset,long_liquidations,short_liquidations\n2025-12-25T07:00:00,BTC,0.0,0.751\n")
    row = files.read_perp_metrics(spark, path, "liquidations").first()
    assert (row.asset, row.short_liquidations) == ("BTC", 0.751)
    with pytest.raises(ValueError):
        files.read_perp_metrics(spark, path, "else")


def test_manifest_and_absent_files(spark, tmp_path):
    for name in ("btc/1672531200.png", "btc/notes.txt", "eth/1672534800.png", "eth/cover.png"):
        put(tmp_path / name, "x")
    rows = files.read_asset_manifest(spark, str(tmp_path)).orderBy("asset").collect()
    assert [(r.asset, r.unix_ts) for r in rows] == [("BTC", 1672531200), ("ETH", 1672534800)]
    assert files.read_if_present(files.read_funding, spark, str(tmp_path / "absent.csv")) is None


# --- sinks ------------------------------------------------------------------


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("BTC", "train", 2, 1.0), ("ETH", "train", 1, 2.0), ("BTC", "validation", 3, 3.0)], "asset string, split string, timestamp long, x double")
    for kind in ("csv", "parquet"):
        sinks.write_table(df, str(tmp_path / kind), kind)
        sinks.write_table(df, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3
    sinks.write_splits(df, str(tmp_path / "splits"))
    back = files.read_split(spark, str(tmp_path / "splits"), "train", ["BTC", "ETH"])
    assert [(r.asset, r.ordinal) for r in back.orderBy("ordinal").collect()] == [("BTC", 0), ("ETH", 1)]
    assert [r.asset for r in files.read_split(spark, str(tmp_path / "splits"), "train", ["BTC", "ETH"], limit=1).collect()] == ["BTC"]


def test_features_and_inventory(spark, tmp_path):
    vec = lambda n, d: spark.range(n).select("id", F.array_repeat(F.lit(0.5).cast("float"), d).alias("v"))
    tables = {"text": vec(4, 8), "image": vec(4, 8), "tabular": vec(4, 7), "target": spark.range(4).select("id", F.lit(1.0).alias("v"))}
    path = str(tmp_path / "features")
    sinks.write_features(tables, path, "train")
    sinks.write_features({**tables, "text": vec(9, 8)}, path, "train")
    columns = dict.fromkeys(sinks.MODALITIES, "v")
    row = sinks.feature_inventory(spark, path, columns).first()
    assert (row.text_rows, row.text_dim, row.tabular_dim, row.target_dim) == (4, 8, 7, 1)
    assert row.complete and row.equal_counts and row.even_vectors
    sinks.write_features({"text": vec(9, 8)}, path, "train", force=True)
    sinks.write_features({"text": vec(2, 8)}, path, "validation")
    got = {r.split: r for r in sinks.feature_inventory(spark, path, columns).collect()}
    assert got["train"].complete and not got["train"].equal_counts and not got["validation"].complete


def test_durable_uses_the_session_folder(spark):
    df = durable(spark.range(3), "check")
    folder = scratch_folder(spark).removeprefix("file:")
    assert df.count() == 3 and all(f"{folder}/check-" in f for f in df.inputFiles())


# --- pipelines --------------------------------------------------------------

LAST = pd.Timestamp("2025-01-31 23:00", tz="UTC")


def bars(spark, n_missing=24):
    """44,568 hourly bars that end on 2025-01-31 23:00, with 24 hours absent earlier."""
    hours = pd.date_range(pd.Timestamp("2020-01-01", tz="UTC"), LAST, freq="h")
    drop = np.arange(5_000, 5_000 + n_missing * 700, 700)
    hours = hours.delete(drop)
    rng = np.random.default_rng(1)
    close = 10_000 * np.exp(np.cumsum(rng.normal(0, 0.004, len(hours))))
    frame = pd.DataFrame({"timestamp": hours, "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": rng.uniform(1, 9, len(hours))})
    assert len(frame) == 44_568
    return spark.createDataFrame(frame).withColumn("asset", F.lit("BTC"))


@pytest.mark.parametrize("rows", [65_536, 4_000])
def test_count_identity(spark, rows):
    """44,568 bars in; charts exist from the 45th bar on; 31,133 / 6,671 / 6,625 rows out."""
    klines = durable(bars(spark), "klines")
    manifest = chart_windows(klines, rows=rows).select("asset", "unix_ts")
    assert manifest.count() == 44_524
    out = durable(align(Sources(klines, manifest=manifest), "2020-01-01", "2025-01-31", rows=rows), "out")
    assert out.count() == 44_477
    got = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert got == {"train": 31_133, "embargo_1": 24, "validation": 6_671, "embargo_2": 24, "test_in_domain": 6_625}
    first = out.orderBy("timestamp").first()
    assert first.return_1h == 0.0 and first.text_content == "[NO_EVENT] market is quiet" and first.funding_rate is None


def _landed(folder):
    """Sixty hours of two assets with every other source."""
    hours = pd.date_range("2023-01-01", periods=60, freq="h")
    for asset, base in (("BTC", 100.0), ("ETH", 10.0)):
        rows = "".join(f"{t},{base},{base},{base},{base + (i * 7) % 13},{i}\n" for i, t in enumerate(hours))
        put(folder / f"{asset}USDT_klines.csv", "timestamp,open,high,low,close,volume\n" + rows)
    put(folder / "BTCUSDT_fundingRate.csv", "calc_time,funding_interval_hours,last_funding_rate\n1672531200000,8,0.1\n1672560000008,8,0.2\n")
    put(folder / "fear_greed_index.csv", "timestamp,datetime,value,value_classification,time_until_update,source\n1,2022-12-31T00:00:00+00:00,9,Old,,x\n2,2023-01-02T00:00:00+00:00,50,Neutral,,x\n")
    put(folder / "gdelt_exogenous_data.csv", "timestamp,gdelt_econ_volume,gdelt_econ_tone,gdelt_conflict_volume\n2023-01-01T05:00:00+00:00,4,-1.5,2\n")
    put(folder / "huggingface_crypto_news.csv", "published_on,combined_text\n2023-01-01 05:50:00,late\n2023-01-01 05:10:00,early\n2023-01-01 06:00:00,\n")


def test_align_folder(spark, tmp_path):
    _landed(tmp_path)
    keep = [h for h in range(60) if h != 9]
    for h in keep:
        put(tmp_path / f"charts/btc/{1672531200 + 3600 * h}.png", "x")
        put(tmp_path / f"charts/eth/{1672531200 + 3600 * h}.png", "x")
    sources = folder_sources(spark, str(tmp_path), ["BTC", "ETH"], str(tmp_path / "charts"))
    out = align(sources, "2023-01-01", "2023-01-03 12:00:00", horizon=4, window=8, rows=16).toPandas()
    out["h"] = ((out["timestamp"] - pd.Timestamp("2023-01-01")).dt.total_seconds() // 3600).astype(int)
    btc = out[out.asset == "BTC"].set_index("h")
    assert list(btc.index) == [h for h in range(2, 56) if h != 9]
    assert btc.loc[8, "funding_rate"] == 0.1 and btc.loc[10, "funding_rate"] == 0.2
    assert out[out.asset == "ETH"]["funding_rate"].isna().all()
    assert np.isnan(btc.loc[23, "fear_greed_value"]) and btc.loc[24, "fear_greed_value"] == 50
    assert btc.loc[5, "text_content"] == "late [SEP] early" and btc.loc[6, "text_content"] == ""
    assert btc.loc[7, "text_content"] == "[NO_EVENT] market is quiet"
    assert btc.loc[5, "gdelt_econ_volume"] == 4 and btc.loc[7, "gdelt_econ_volume"] == 0
    close = lambda h: 100.0 + (h * 7) % 13
    assert btc.loc[10, "return_1h"] == pytest.approx((close(10) / close(8) - 1) * 100)
    assert btc.loc[2, "return_1h"] == 0
    assert btc.loc[2, "image_path"] == f"charts/btc/{1672531200 + 7200}.png"
    assert list(out.columns[:4]) == ["asset", "split", "row_idx", "timestamp"] and out.columns[-2] == "target_score"


def test_verify_report(spark, tmp_path):
    hours = pd.date_range("2023-01-01", periods=300, freq="h", tz="UTC").delete(50)
    rng = np.random.default_rng(2)
    parts = [
        pd.DataFrame({"asset": a, "timestamp": hours, "row": np.arange(299), "volume": rng.uniform(1, 2, 299), "target_score": rng.uniform(-90, 90, 299), "text_content": "news"})
        for a in ("BTC", "ETH")
    ]
    df = spark.createDataFrame(pd.concat(parts)).withColumn(
        "split", F.when(F.col("row") < 200, "train").when(F.col("row") < 224, "gap").when(F.col("row") < 250, "validation").when(F.col("row") < 260, "gap").otherwise("test_in_domain")
    )
    claims = spark.createDataFrame([("rows", "BTC/train", 200.0, 0.0), ("text", "no_event_pct", 15.1, 1.0)], "check string, subject string, claimed double, tolerance double")
    report = verify_dataset(df.where("split <> 'gap'"), ["volume"], claims, ("BTC", "ETH"), rows=64)
    got = {(r.check, r.subject): r for r in report.collect()}
    assert got["rows", "BTC/train"].ok and got["text", "no_event_pct"].ok is False and got["text", "no_event_pct"].actual is None
    assert got["bounds", "BTC/train/target_score"].ok and got["nulls", "ETH/train/TOTAL"].ok and got["nulls", "ETH/train/volume"].actual == 0
    volumes = df.where("asset = 'ETH' AND split = 'validation'").toPandas()["volume"]
    assert got["feature", "ETH/validation/volume/mean"].actual == pytest.approx(volumes.mean())
    assert got["quartile", "ETH/validation/volume/q3"].actual == pytest.approx(volumes.quantile(0.75))
    assert got["text", "BTC/test_in_domain/max_chars"].actual == 4
    assert 0 <= got["ttest", "volume/p_value"].actual <= 1 and got["ttest", "volume/stars"].actual in (0, 1, 2, 3)
    assert got["embargo", "BTC/1"].ok and not got["embargo", "BTC/2"].ok
    assert got["gaps", "BTC"].actual == 3 and not got["gaps", "BTC"].ok


def test_published(spark):
    df = spark.createDataFrame([("train",), ("embargo_1",)], "split string")
    assert published(df).count() == 1


def test_training_windows(spark):
    from tsalign.operators.features import encoder_of
    from tsalign.plans.training import feature_tables, training_windows

    rng = np.random.default_rng(4)
    parts = []
    for asset in ("BTC", "ETH"):
        n = 80
        parts.append(pd.DataFrame({"asset": asset, "row_idx": np.arange(n), "split": ["train"] * 40 + ["validation"] * 40, "a": rng.normal(size=n), "b": rng.normal(size=n) * 5, "target_score": rng.normal(size=n), "text_content": "one two"}))
    data = pd.concat(parts, ignore_index=True)
    features = feature_tables(spark.createDataFrame(data), encoder_of(8), ["a", "b"])
    train = data[data.split == "train"]
    mean, std = train[["a", "b"]].mean(), train[["a", "b"]].std(ddof=0)
    q1, median, q3 = train["target_score"].quantile([0.25, 0.5, 0.75])
    for across, count in ((False, 2 * 16), (True, 80 - 24)):
        got = training_windows(features, "validation", width=2, across_assets=across, rows=10).toPandas()
        assert len(got) == count
        row = got[(got.asset == "ETH") & (got.row_idx == 70)].iloc[0]
        eth = data[(data.asset == "ETH") & (data.row_idx.between(46, 69))]
        np.testing.assert_allclose(np.array([list(v) for v in row["tabular"]]), (eth[["a", "b"]] - mean) / std, rtol=1e-4, atol=1e-5)
        assert np.array([list(v) for v in row["text"]]).shape == (24, 8)
        y = data[(data.asset == "ETH") & (data.row_idx == 70)]["target_score"].iloc[0]
        assert row["target"] == pytest.approx((y - median) / (q3 - q1), rel=1e-4)
