"""Readers of landed files. Every reader is one lazy scan with an explicit projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsalign.functions.text import asset_list, clean_text, combine_news_text, combine_post_text, text_hash
from tsalign.functions.time import floor_hour, from_millis, parse_iso, to_numeric
from tsalign.operators.dedupe import concat_assets, dedupe_keep_first
from tsalign.operators.filters import PLACEHOLDER
from tsalign.sources.records import read_csv_records
from tsalign.sources.zipped import line_order, numeric_lines, read_zipped

# The twelve positional columns of a raw bar file.
RAW_KLINE_COLUMNS = [
    "timestamp",
    "open",
    "high",
    "low",
    "close",
    "volume",
    "close_time",
    "quote_volume",
    "count",
    "taker_buy_volume",
    "taker_buy_quote_volume",
    "ignore",
]
BARS = ["open", "high", "low", "close", "volume"]

FILE_ORDER = ["_file", "_block", "_line"]
"""Columns that restore file order: path, offset of the file block, line counter inside the scan task."""


def read_csv(spark: SparkSession, path: str | Sequence[str], multiline: bool = False) -> DataFrame:
    """Header CSV, all columns as text; quotes are doubled inside quoted fields."""
    return spark.read.csv(path, header=True, multiLine=multiline, escape='"')


def with_file_order(df: DataFrame) -> DataFrame:
    """Add :data:`FILE_ORDER`. Spark packs file blocks into tasks in any order, so a bare row id is not enough."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _names(df: DataFrame, *candidates: str) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of the columns {', '.join(candidates)} exists")


def _numbers(cols: Sequence[str]) -> list[Column]:
    return [to_numeric(F.col(c)).alias(c) for c in cols]


def read_klines(spark: SparkSession, path: str, for_indicators: bool = False, ordered: bool = True) -> DataFrame:
    """Bars from a header CSV, sorted by time unless ``ordered`` is off.

    The indicator path takes ``datetime`` before ``timestamp`` and does not sort.
    """
    raw = read_csv(spark, path)
    stamp = _names(raw, "datetime", "timestamp") if for_indicators else _names(raw, "timestamp")
    bars = raw.select(parse_iso(F.col(stamp)).alias("timestamp"), *_numbers(BARS))
    return bars.orderBy("timestamp") if ordered and not for_indicators else bars


def read_klines_raw(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Twelve positional columns, six kept; only a header line (first field not numeric) is dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RAW_KLINE_COLUMNS])
    raw = spark.read.schema(schema).csv(paths, header=False)
    kept = with_file_order(raw).where(F.col("timestamp").try_cast("double").isNotNull())
    return kept.select(from_millis(F.col("timestamp")).alias("timestamp"), *_numbers(BARS), *FILE_ORDER)


def month_paths(df: DataFrame, start: Column, end: Column, template: str) -> DataFrame:
    """One row per input row and month from ``start`` to ``end``: ``month`` as ``YYYY-MM`` and its path."""
    firsts = F.sequence(start.cast("date"), end.cast("date"), F.expr("interval 1 month"))
    months = df.select("*", F.explode(firsts).alias("month")).withColumn("month", F.date_format("month", "yyyy-MM"))
    return months.withColumn("path", F.format_string(template, "month"))


def _months(start: str, end: str) -> list[str]:
    months, at, last = [], date.fromisoformat(start[:10]).replace(day=1), date.fromisoformat(end[:10])
    while at <= last:
        months.append(f"{at:%Y-%m}")
        at = (at + timedelta(days=31)).replace(day=1)
    return months


_NO_BARS = ", ".join(["timestamp timestamp", *[f"{c} double" for c in BARS]])


def read_monthly(spark: SparkSession, folder: str, prefix: str, start: str, end: str) -> DataFrame:
    """All monthly bar files of a series, sorted, first row per stamp; absent months do not match the glob."""
    months = _months(start, end)
    merged = read_if_present(read_klines_raw, spark, f"{folder}/{prefix}{{{','.join(months)}}}*") if months else None
    if merged is None:
        return spark.createDataFrame([], _NO_BARS)
    return dedupe_keep_first(merged, ["timestamp"], FILE_ORDER).drop(*FILE_ORDER).orderBy("timestamp")


def read_monthly_series(spark: SparkSession, folder: str, prefixes: Mapping[str, str], start: str, end: str) -> DataFrame:
    """``asset, ordinal`` and the bars of several series from one scan, first row per series and stamp.

    ``prefixes`` maps an asset to the beginning of its files' paths below ``folder``; none may begin another. Rows are not sorted.
    """
    months, merged = _months(start, end), None
    if months and prefixes:
        merged = read_if_present(read_klines_raw, spark, f"{folder}/{{{','.join(prefixes.values())}}}{{{','.join(months)}}}*")
    if merged is None:
        return spark.createDataFrame([], f"asset string, ordinal int, {_NO_BARS}")
    below = F.substring_index("_file", f"{folder.rsplit('/', 1)[-1]}/", -1)
    ordinal = F.coalesce(*[F.when(below.startswith(p), F.lit(i)) for i, p in enumerate(prefixes.values())])
    first = dedupe_keep_first(merged.withColumn("ordinal", ordinal), ["ordinal", "timestamp"], FILE_ORDER)
    names = F.element_at(F.array(*[F.lit(a) for a in prefixes]), F.col("ordinal") + 1)
    return first.select(names.alias("asset"), "ordinal", "timestamp", *BARS)


def read_monthly_zipped(spark: SparkSession, folder: str, prefix: str, start: str, end: str) -> DataFrame:
    """As :func:`read_monthly` for archives ``<prefix><month>….zip`` with delimited members; a task for each member."""
    globs = [f"{prefix}{m}*.zip" for m in _months(start, end)]
    if not globs:
        return spark.createDataFrame([], _NO_BARS)
    raw = numeric_lines(read_zipped(spark, folder, RAW_KLINE_COLUMNS, ["timestamp", *BARS], globs), "timestamp")
    bars = raw.select(from_millis(F.col("timestamp")).alias("timestamp"), *_numbers(BARS), *line_order())
    return dedupe_keep_first(bars, ["timestamp"], line_order()).drop(*line_order()).orderBy("timestamp")


def read_funding(spark: SparkSession, path: str) -> DataFrame:
    """Exact millisecond stamps; they are not rounded to the hour."""
    raw = with_file_order(read_csv(spark, path))
    return raw.select(
        from_millis(F.col("calc_time")).alias("timestamp"),
        to_numeric(F.col("last_funding_rate")).alias("funding_rate"),
        *FILE_ORDER,
    )


def read_fear_greed_json(
    spark: SparkSession, path: str, start: str | None = None, end: str | None = None, multiline: bool = True
) -> DataFrame:
    """Index payload to rows: defaults for absent fields, inclusive date filter, sorted.

    One payload per file, or one per line with ``multiline=False``.
    """
    text = T.StringType()
    entry = T.StructType(
        [T.StructField(c, text) for c in ("timestamp", "value", "value_classification", "time_until_update")]
    )
    schema = T.StructType([T.StructField("data", T.ArrayType(entry))])
    raw = spark.read.schema(schema).json(path, multiLine=multiline)
    entries = raw.select(
        F.explode(
            F.when(F.col("data").isNull(), F.raise_error(F.lit("payload has no data field"))).otherwise(F.col("data"))
        ).alias("e")
    )
    second = F.coalesce(F.col("e.timestamp").try_cast("long"), F.lit(0))
    rows = entries.select(
        second.alias("timestamp"),
        F.when(second > 0, F.timestamp_seconds(second)).alias("datetime"),
        F.coalesce(F.col("e.value").try_cast("int"), F.lit(0)).alias("value"),
        F.coalesce("e.value_classification", F.lit("Unknown")).alias("value_classification"),
        to_numeric(F.col("e.time_until_update")).alias("time_until_update"),
        F.lit("alternative.me").alias("source"),
    )
    if start is not None:
        rows = rows.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("datetime") <= F.lit(end).cast("timestamp"))
    return rows.orderBy("timestamp")


def read_fear_greed(spark: SparkSession, path: str) -> DataFrame:
    raw = with_file_order(read_csv(spark, path))
    return raw.select(
        parse_iso(F.col("datetime")).alias("timestamp"),
        F.col("value").try_cast("int").alias("fear_greed_value"),
        F.col("value_classification").alias("fear_greed_class"),
        *FILE_ORDER,
    )


def read_macro(spark: SparkSession, path: str) -> DataFrame:
    """Hourly macro news; missing volumes and tone read as 0."""
    raw = read_csv(spark, path)
    volume = lambda c: F.coalesce(to_numeric(F.col(c)), F.lit(0.0)).cast("long").alias(c)
    return raw.select(
        parse_iso(F.col("timestamp")).alias("timestamp"),
        volume("gdelt_econ_volume"),
        F.coalesce(to_numeric(F.col("gdelt_econ_tone")), F.lit(0.0)).alias("gdelt_econ_tone"),
        volume("gdelt_conflict_volume"),
    )


def read_news(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Stamp and combined text of each article in file order; other columns are never parsed.

    Article bodies may hold line breaks inside quotes; a file is read in many
    tasks all the same (:mod:`tsalign.sources.records`). ``multiline=False``
    spares flat texts the scan that finds where quotes are open.
    """
    raw = read_csv(spark, path, multiline)
    if "combined_text" in raw.columns:
        text = F.col("combined_text")
    else:
        text = combine_news_text(F.col(_names(raw, "title")), F.col(_names(raw, "body")))
    placed = read_csv_records(spark, path, raw.columns) if multiline else with_file_order(raw)
    return placed.select(parse_iso(F.col("published_on")).alias("timestamp"), text.alias("text_content"), *FILE_ORDER)


_LISTING = """data struct<after: string, children: array<struct<data: struct<
    title: string, selftext: string, created_utc: double, url: string,
    score: bigint, num_comments: bigint, author: string>>>>"""


def read_posts_json(
    spark: SparkSession, path: str, subreddit: str, default_ts: Column | None = None, multiline: bool = True
) -> DataFrame:
    """Listing pages to posts: cleaned texts, hour, assets, hash; posts without text are skipped."""
    pages = spark.read.schema(_LISTING).json(path, multiLine=multiline)
    posts = pages.select(F.explode("data.children.data").alias("p"))
    created = F.when(F.col("p.created_utc") != 0, F.timestamp_seconds(F.col("p.created_utc")))
    cleaned = posts.select(
        "p",
        floor_hour(created, default_ts).alias("timestamp"),
        clean_text(F.col("p.title")).alias("title"),
        clean_text(F.col("p.selftext")).alias("text"),
    ).withColumn("combined_text", combine_post_text(F.col("title"), F.col("text")))
    return cleaned.where(F.col("combined_text") != "").select(
        "timestamp",
        F.lit(subreddit).alias("subreddit"),
        "title",
        "text",
        "combined_text",
        F.coalesce("p.url", F.lit("")).alias("url"),
        F.coalesce("p.score", F.lit(0)).alias("score"),
        F.coalesce("p.num_comments", F.lit(0)).alias("num_comments"),
        F.coalesce("p.author", F.lit("")).alias("author"),
        asset_list(F.col("combined_text")).alias("assets"),
        text_hash(F.col("combined_text")).alias("text_hash"),
        F.lit("reddit").alias("source"),
    )


# Value columns of the three derivative-market tables.
PERP_COLUMNS = {
    "open_interest": ["open", "high", "low", "close"],
    "liquidations": ["long_liquidations", "short_liquidations"],
    "long_short_ratio": ["ratio", "long_percentage", "short_percentage"],
}


def read_perp_metrics(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind not in PERP_COLUMNS:
        raise ValueError(f"unknown kind: {kind}")
    raw = read_csv(spark, path)
    return raw.select(parse_iso(F.col("timestamp")).alias("timestamp"), "asset", *_numbers(PERP_COLUMNS[kind]))


# What an absent source contributes.
SOURCE_DEFAULTS = {
    "funding": {"funding_rate": (None, "double")},
    "fear_greed": {"fear_greed_value": (None, "int"), "fear_greed_class": ("Unknown", "string")},
    "macro": {
        "gdelt_econ_volume": (0, "long"),
        "gdelt_econ_tone": (0.0, "double"),
        "gdelt_conflict_volume": (0, "long"),
    },
    "news": {"text_content": (PLACEHOLDER, "string")},
}


def with_source_default(df: DataFrame, source: str) -> DataFrame:
    """Constant columns in place of an absent source."""
    return df.withColumns({c: F.lit(v).cast(t) for c, (v, t) in SOURCE_DEFAULTS[source].items()})


def read_if_present(reader, spark: SparkSession, path: str) -> DataFrame | None:
    """``reader(spark, path)``, or None when nothing is at ``path``."""
    try:
        return reader(spark, path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def read_asset_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``(asset, unix_ts, path)`` of the PNG files under ``folder/<asset>/``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.png")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path")
    )
    return files.select(
        F.upper(F.regexp_extract("path", r"([^/]+)/\d+\.png$", 1)).alias("asset"),
        F.regexp_extract("path", r"(\d+)\.png$", 1).try_cast("long").alias("unix_ts"),
        "path",
    ).where(F.col("unix_ts").isNotNull())


def read_split(
    spark: SparkSession, path: str, split: str, assets: Sequence[str], order: str = "timestamp", limit: int | None = None
) -> DataFrame:
    """One split of all assets in asset order; partition pruning reads only its folders.

    ``limit`` keeps the first rows of the concatenation, for debugging.
    """
    table = spark.read.parquet(path).where(F.col("split") == split)
    both = concat_assets({a: table.where(F.col("asset") == a) for a in assets})
    return both if limit is None else both.orderBy("ordinal", order).limit(limit)
