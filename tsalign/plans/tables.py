"""Adapters: the given tables in the shapes the operators expect, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.functions.time import hour_number
from tsalign.operators.chunk import grid_index
from tsalign.session import use_utc


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{table}.parquet")


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars per event type: one row per ``(asset, hour_no)``."""
    first, last = F.struct("ts", "event_id"), F.struct("ts", "event_id")
    hour = F.date_trunc("hour", "ts")
    return (
        load(spark, folder, "events")
        .where(F.col("value").isNotNull())
        .groupBy(F.col("event_type").alias("asset"), hour.alias("timestamp"))
        .agg(
            F.min_by("value", first).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", last).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .withColumn("hour_no", hour_number("timestamp"))
    )


def indexed_bars(spark: SparkSession, folder: str) -> DataFrame:
    return grid_index(bars(spark, folder), ["asset"], "hour_no")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars per order priority: one row per ``(asset, day_no)``."""
    day = F.to_date("o_orderdate")
    return (
        load(spark, folder, "orders")
        .groupBy(F.col("o_orderpriority").alias("asset"), day.alias("day"))
        .agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"),
            F.max("o_totalprice").alias("high"),
            F.min("o_totalprice").alias("low"),
            F.max_by("o_totalprice", "o_orderkey").alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .withColumn("day_no", F.unix_date("day").cast("long"))
    )


def indexed_daily(spark: SparkSession, folder: str) -> DataFrame:
    return grid_index(daily(spark, folder), ["asset"], "day_no")


def rates(spark: SparkSession, folder: str) -> DataFrame:
    """The ``view`` events as the low-frequency rate series."""
    return (
        load(spark, folder, "events")
        .where(F.col("event_type") == "view")
        .select(F.col("ts").cast("timestamp").alias("timestamp"), "event_id", F.col("value").alias("rate"))
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A rule on the user as the prediction of an event's value: one run per type, one epoch per day."""
    return load(spark, folder, "events").select(
        F.col("event_id").alias("idx"),
        F.col("event_type").alias("run"),
        F.dayofmonth("ts").cast("long").alias("epoch"),
        (F.col("user_id") % 50 + 25).cast("double").alias("prediction"),
        F.col("value").alias("target"),
    )


BARS = """bars AS (
  SELECT event_type AS asset, date_trunc('hour', ts) AS timestamp,
         CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour_no,
         first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
         last(value ORDER BY ts, event_id) AS close, count(*) AS volume
  FROM events WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""

DAILY = """daily AS (
  SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS day,
         first(o_totalprice ORDER BY o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         last(o_totalprice ORDER BY o_orderkey) AS close, count(*) AS volume,
         row_number() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE)) - 1 AS row_idx
  FROM orders GROUP BY 1, 2)"""

RATES = """rates AS (
  SELECT ts, last(value ORDER BY event_id) AS rate FROM events WHERE event_type = 'view' GROUP BY ts)"""

STAMP = "strftime(timestamp, '%Y-%m-%d %H:%M:%S')"

SPLIT_CASE = """CASE WHEN idx < floor(0.7::DOUBLE * n) THEN 'train'
       WHEN idx < floor(0.7::DOUBLE * n) + 24 THEN 'embargo_1'
       WHEN idx < floor(0.7::DOUBLE * n) + 24 + floor(0.15::DOUBLE * n) THEN 'validation'
       WHEN idx < floor(0.7::DOUBLE * n) + 48 + floor(0.15::DOUBLE * n) THEN 'embargo_2'
       ELSE 'test_in_domain' END"""

PREDICTIONS = """pred AS (
  SELECT event_id AS idx, event_type AS run, day(ts) AS epoch, CAST(user_id % 50 + 25 AS DOUBLE) AS prediction, value AS target
  FROM events)"""
