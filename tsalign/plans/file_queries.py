"""Queries over landed files: given tables are written in a source's format and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.functions.text import asset_list, clean_text, combine_post_text
from tsalign.operators.durable import scratch_folder
from tsalign.operators.dedupe import concat_assets
from tsalign.operators.profile import image_sample_report
from tsalign.operators.split import chronological_split
from tsalign.plans.registry import query
from tsalign.plans.series_queries import _SPLIT
from tsalign.plans.tables import BARS, DAILY, STAMP, bars, daily, load, stamp
from tsalign.plans.text_queries import KINDS, PATTERNS, clean_sql
from tsalign.sources import files, images, sinks, zipped


def _place(spark: SparkSession, label: str) -> str:
    return f"{scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _landed(df: DataFrame, label: str) -> str:
    path = _place(df.sparkSession, label)
    sinks.write_table(df, path, "csv")
    return path


MARKET = """market AS (
  SELECT date_trunc('hour', ts) AS timestamp, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1)"""


def _market(spark, folder):
    """Hourly bars over all events: one series."""
    order = F.struct("ts", "event_id")
    return load(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.min_by("value", order).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", order).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


_MARKET_ROWS = f"WITH {MARKET} SELECT {STAMP} AS timestamp, open, high, low, close, volume FROM market"


@query("read_klines", _MARKET_ROWS)
def read_klines(spark, folder):
    path = _landed(_market(spark, folder), "klines")
    return files.read_klines(spark, path).withColumn("timestamp", stamp("timestamp"))


@query("read_klines_raw", _MARKET_ROWS)
def read_klines_raw(spark, folder):
    zero = {c: F.lit(0) for c in files.RAW_KLINE_COLUMNS[6:]}
    raw = _market(spark, folder).withColumn("timestamp", F.unix_millis("timestamp")).withColumns(zero)
    out = files.read_klines_raw(spark, _landed(raw.select(*files.RAW_KLINE_COLUMNS), "klines-raw"))
    return out.drop(*files.FILE_ORDER).withColumn("timestamp", stamp("timestamp"))


# The priorities of the orders.
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]

_MONTHLY = f"""WITH {DAILY} SELECT asset, strftime(day, '%Y-%m-%d') AS day, close FROM daily
WHERE day BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'"""


def _raw_days(spark, folder):
    """Orders as a daily series for each priority, in the columns of a raw bar file."""
    series = daily(spark, folder).withColumn("series", F.substring("asset", 1, 1))
    zero = {c: F.lit(0) for c in files.RAW_KLINE_COLUMNS[6:]}
    raw = series.withColumn("timestamp", F.unix_millis(F.col("day").cast("timestamp"))).withColumns(zero)
    return raw.select(*files.RAW_KLINE_COLUMNS, "series", F.date_format("day", "yyyy-MM").alias("month"))


@query("read_monthly", _MONTHLY)
def read_monthly(spark, folder):
    """Daily series, landed in monthly folders, every bar twice."""
    raw = _raw_days(spark, folder)
    path = _place(spark, "monthly")
    raw.unionByName(raw).write.partitionBy("series", "month").csv(path)
    prefixes = {n: f"series={n[0]}/month=" for n in _PRIORITIES}
    out = files.read_monthly_series(spark, path, prefixes, "1996-01-01", "1999-12-01")
    return out.select("asset", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "close")


@query("read_monthly_zipped", _MONTHLY)
def read_monthly_zipped(spark, folder):
    """The same series, landed as one archive per series and month, every bar twice."""
    raw = _raw_days(spark, folder)
    path = _place(spark, "zipped")
    zipped.write_zipped(raw.unionByName(raw), path, ["series", "month"], "s{}-1d-{}", files.RAW_KLINE_COLUMNS, "timestamp").agg(F.sum("rows")).collect()
    parts = {n: files.read_monthly_zipped(spark, path, f"s{n[0]}-1d-", "1996-01-01", "1999-12-01") for n in _PRIORITIES}
    return concat_assets(parts).select("asset", F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "close")


@query(
    "read_funding",
    """SELECT epoch_us(ts) // 1000 AS ms, value AS funding_rate FROM events""",
)
def read_funding(spark, folder):
    raw = load(spark, folder, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("calc_time"),
        F.lit(8).alias("funding_interval_hours"),
        F.col("value").alias("last_funding_rate"),
    )
    out = files.read_funding(spark, _landed(raw, "funding"))
    return out.select(F.unix_millis("timestamp").alias("ms"), "funding_rate")


INDEX = """index_ AS (SELECT event_type, date_trunc('day', ts) AS timestamp, CAST(max(value) AS INTEGER) AS value,
  CASE WHEN count(*) % 3 <> 0 THEN event_type END AS label FROM events GROUP BY 1, 2)"""


def _index(spark, folder):
    """Daily maximum per event type as the index; every third size has no class."""
    return load(spark, folder, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(
        F.round(F.max("value")).cast("int").alias("value"),
        F.when(F.count(F.lit(1)) % 3 != 0, F.col("event_type")).alias("value_classification"),
    )


@query(
    "read_fear_greed_json",
    f"""WITH {INDEX} SELECT CAST(epoch(timestamp) AS BIGINT) AS timestamp, strftime(timestamp, '%Y-%m-%d') AS day, value,
  coalesce(label, 'Unknown') AS value_classification, 'alternative.me' AS source FROM index_
WHERE timestamp BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-28'""",
)
def read_fear_greed_json(spark, folder):
    """One payload per event type and day; a payload holds its entries as an array."""
    entry = F.struct(
        F.unix_seconds("day").cast("string").alias("timestamp"), F.col("value").cast("string").alias("value"), "value_classification"
    )
    path = _place(spark, "index")
    _index(spark, folder).select(F.to_json(F.struct(F.array(entry).alias("data"))).alias("value")).write.text(path)
    out = files.read_fear_greed_json(spark, path, "2024-01-03", "2024-01-28", multiline=False)
    return out.select(
        "timestamp", F.date_format("datetime", "yyyy-MM-dd").alias("day"), "value", "value_classification", "source"
    )


@query(
    "read_fear_greed",
    f"WITH {INDEX} SELECT strftime(timestamp, '%Y-%m-%d') AS day, value AS fear_greed_value, label AS fear_greed_class FROM index_",
)
def read_fear_greed(spark, folder):
    raw = _index(spark, folder).select(
        F.unix_seconds("day").alias("timestamp"),
        F.date_format("day", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("datetime"),
        "value",
        "value_classification",
    )
    out = files.read_fear_greed(spark, _landed(raw, "index-csv"))
    return out.select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "fear_greed_value", "fear_greed_class")


@query(
    "read_macro",
    """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS timestamp, count(*) FILTER (event_type = 'view') AS gdelt_econ_volume,
  coalesce(max(value) FILTER (event_type = 'view'), 0) AS gdelt_econ_tone, count(*) FILTER (event_type = 'error') AS gdelt_conflict_volume
FROM events GROUP BY 1""",
)
def read_macro(spark, folder):
    """Zero volumes and unknown tones are landed as empty fields."""
    kind = F.col("event_type")
    hours = load(spark, folder, "events").groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.nullif(F.count_if(kind == "view"), F.lit(0)).alias("gdelt_econ_volume"),
        F.max(F.when(kind == "view", F.col("value"))).alias("gdelt_econ_tone"),
        F.nullif(F.count_if(kind == "error"), F.lit(0)).alias("gdelt_conflict_volume"),
    )
    return files.read_macro(spark, _landed(hours, "macro")).withColumn("timestamp", stamp("timestamp"))


@query(
    "read_news",
    """SELECT sha256(source || ' ' || text) AS digest, strftime(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS timestamp
FROM documents""",
)
def read_news(spark, folder):
    """Documents as articles; texts hold quotes and line breaks."""
    raw = load(spark, folder, "documents").select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("published_on"),
        F.col("source").alias("title"),
        F.col("text").alias("body"),
        "lang",
    )
    out = files.read_news(spark, _landed(raw, "news"))
    return out.select(F.sha2("text_content", 256).alias("digest"), stamp("timestamp").alias("timestamp"))


_POSTS = f"""posts AS (SELECT {clean_sql('role')} AS title, {clean_sql('text')} AS text, conv_id, turn FROM conversations),
combined AS (SELECT *, trim(title || ' ' || text) AS combined_text FROM posts)"""


@query(
    "read_posts_json",
    f"""WITH {_POSTS}
SELECT strftime(date_trunc('hour', TIMESTAMP '2024-01-01' + to_seconds(conv_id * 600 + turn)), '%Y-%m-%d %H:%M:%S') AS timestamp,
  title, text, sha256(lower(combined_text)) AS text_hash, conv_id AS score, turn AS num_comments FROM combined WHERE combined_text <> ''""",
)
def read_posts_json(spark, folder):
    """Turns as posts, one listing page per conversation."""
    post = F.struct(
        F.col("role").alias("title"),
        F.col("text").alias("selftext"),
        (F.lit(1704067200.0) + F.col("conv_id") * 600 + F.col("turn")).alias("created_utc"),
        F.col("conv_id").alias("score"),
        F.col("turn").alias("num_comments"),
    )
    pages = load(spark, folder, "conversations").select(
        F.to_json(F.struct(F.struct(F.array(F.struct(post.alias("data"))).alias("children")).alias("data"))).alias("value")
    )
    path = _place(spark, "posts")
    pages.write.text(path)
    out = files.read_posts_json(spark, path, "all", multiline=False)
    return out.select(
        stamp("timestamp").alias("timestamp"), "title", "text", "text_hash", "score", "num_comments"
    )


@query("read_perp_metrics", f"WITH {BARS} SELECT {STAMP} AS timestamp, asset, open, high, low, close FROM bars")
def read_perp_metrics(spark, folder):
    raw = bars(spark, folder).select("timestamp", "asset", "open", "high", "low", "close")
    out = files.read_perp_metrics(spark, _landed(raw, "open-interest"), "open_interest")
    return out.withColumn("timestamp", stamp("timestamp"))


@query(
    "read_perp_liquidations",
    f"WITH {BARS} SELECT {STAMP} AS timestamp, asset, high AS long_liquidations, low AS short_liquidations FROM bars",
)
def read_perp_liquidations(spark, folder):
    raw = bars(spark, folder).select("timestamp", "asset", F.col("high").alias("long_liquidations"), F.col("low").alias("short_liquidations"))
    out = files.read_perp_metrics(spark, _landed(raw, "liquidations"), "liquidations")
    return out.withColumn("timestamp", stamp("timestamp"))


@query(
    "read_perp_ratio",
    f"WITH {BARS} SELECT {STAMP} AS timestamp, asset, open AS ratio, high AS long_percentage, low AS short_percentage FROM bars",
)
def read_perp_ratio(spark, folder):
    raw = bars(spark, folder).select(
        "timestamp", "asset", F.col("open").alias("ratio"), F.col("high").alias("long_percentage"), F.col("low").alias("short_percentage")
    )
    out = files.read_perp_metrics(spark, _landed(raw, "ratio"), "long_short_ratio")
    return out.withColumn("timestamp", stamp("timestamp"))


@query(
    "source_default",
    f"""WITH {BARS} SELECT asset, {STAMP} AS timestamp, CAST(NULL AS DOUBLE) AS funding_rate, CAST(NULL AS INTEGER) AS fear_greed_value,
  'Unknown' AS fear_greed_class, 0::BIGINT AS gdelt_econ_volume, 0::DOUBLE AS gdelt_econ_tone, 0::BIGINT AS gdelt_conflict_volume,
  '[NO_EVENT] market is quiet' AS text_content FROM bars""",
)
def source_default(spark, folder):
    out = bars(spark, folder).select("asset", stamp("timestamp").alias("timestamp"))
    for source in files.SOURCE_DEFAULTS:
        out = files.with_source_default(out, source)
    return out


@query(
    "read_split",
    f"""WITH {BARS}, {_SPLIT} SELECT asset, list_position({KINDS}, asset)::INTEGER - 1 AS ordinal, {STAMP} AS timestamp, close
FROM parts WHERE split = 'train'""",
)
def read_split(spark, folder):
    path = _place(spark, "splits")
    sinks.write_splits(chronological_split(bars(spark, folder), ["asset"], "hour_no"), path)
    out = files.read_split(spark, path, "train", KINDS)
    return out.select("asset", "ordinal", stamp("timestamp").alias("timestamp"), "close")


@query(
    "feature_inventory",
    """SELECT 'train' AS split, count(*) AS text_rows, 32 AS text_dim, count(*) AS image_rows, 32 AS image_dim, count(*) AS tabular_rows,
  2 AS tabular_dim, count(*) AS target_rows, 1 AS target_dim, true AS complete, true AS equal_counts, true AS even_vectors FROM embeddings""",
)
def feature_inventory(spark, folder):
    rows = load(spark, folder, "embeddings")
    tables = {
        "text": rows.select("vec_id", F.slice("embedding", 1, 32).alias("vector")),
        "image": rows.select("vec_id", F.slice("embedding", 33, 32).alias("vector")),
        "tabular": rows.select("vec_id", F.array(F.col("label").cast("float"), F.col("vec_id").cast("float")).alias("vector")),
        "target": rows.select("vec_id", F.col("label").cast("float").alias("vector")),
    }
    path = _place(spark, "features")
    sinks.write_features(tables, path, "train")
    return sinks.feature_inventory(spark, path, dict.fromkeys(sinks.MODALITIES, "vector"))


_HITS = ", ".join(
    f"CASE WHEN regexp_matches(lower(combined_text), '{'|'.join(words)}') THEN '{asset}' END" for asset, words in PATTERNS.items()
)


@query(
    "detected_posts",
    f"""WITH {_POSTS}
SELECT conv_id, turn, coalesce(nullif(concat_ws(',', {_HITS}), ''), 'OTHER') AS assets FROM combined""",
)
def detected_posts(spark, folder):
    title, text = clean_text(F.col("role")), clean_text(F.col("text"))
    return load(spark, folder, "conversations").select(
        "conv_id", "turn", asset_list(combine_post_text(title, text), PATTERNS).alias("assets")
    )


@query(
    "image_report_files",
    """WITH one AS (SELECT upper('src' || (page_id % 7)) AS asset, html IS NOT NULL AND length(html) % 5 <> 0 AS valid,
    1 + length(html) % 3 AS w FROM pages),
sizes AS (SELECT asset, w, count(*) AS n FROM one WHERE valid GROUP BY 1, 2),
top AS (SELECT asset, count(*) AS resolutions, arg_max(w || 'x64', (n, -w)) AS dominant FROM sizes GROUP BY 1)
SELECT asset, count(*) AS n_rows, count(*) FILTER (valid) AS n_valid, count(*) - count(*) FILTER (valid) AS n_invalid,
  coalesce(any_value(resolutions), 0) AS resolutions, any_value(dominant) AS dominant, round(100.0 * count(*) FILTER (valid) / count(*), 6) AS coverage_pct
FROM one LEFT JOIN top USING (asset) GROUP BY asset""",
)
def image_report_files(spark, folder):
    """An image file for each page, sized by its length, every fifth length cut short; the report comes from the files."""
    place = _place(spark, "images")
    pages = load(spark, folder, "pages").select("page_id", F.length("html").alias("n"))

    def draw(batches):
        import pyarrow as pa

        system, root = zipped.located(place)
        for batch in batches:
            for page_id, n in zip(batch.column("page_id").to_pylist(), batch.column("n").to_pylist()):
                name = f"{root}/src{page_id % 7}"
                system.create_dir(name)
                data = images.png_header(1 + (n or 0) % 3, 64)
                with system.open_output_stream(f"{name}/{page_id}.png") as out:
                    out.write(data if n is not None and n % 5 else data[:20])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    pages.mapInArrow(draw, "n long").agg(F.sum("n")).collect()
    expected = pages.select(F.concat(F.lit("SRC"), (F.col("page_id") % 7).cast("string")).alias("asset"), F.col("page_id").alias("unix_ts"))
    covered = images.image_coverage(expected, images.read_image_sizes(spark, place), ["asset", "unix_ts"])
    out = image_sample_report(covered, "path", "width", "height", ["asset"])
    return out.select(
        "asset", F.col("rows").alias("n_rows"), F.col("valid").alias("n_valid"), F.col("invalid").alias("n_invalid"), "resolutions", "dominant",
        F.round("coverage_pct", 6).alias("coverage_pct"),
    )
