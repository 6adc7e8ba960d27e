"""The alignment and the chart inputs end to end, on sources derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsalign.operators.filters import PLACEHOLDER
from tsalign.plans.align import Sources, align, published
from tsalign.plans.charts import chart_windows
from tsalign.plans.registry import query
from tsalign.plans.tables import BARS, SPLIT_CASE, STAMP, bars, load, r, stamp

START, END = "2024-01-02 06:00:00", "2024-01-29 12:00:00"


def _sources(spark, folder) -> Sources:
    """Rates for each asset, a daily index, hourly macro counts with every fourth hour twice, texts and charts."""
    events = load(spark, folder, "events").withColumn("timestamp", F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    funding = events.groupBy(kind.alias("asset"), "timestamp").agg(F.max("value").alias("funding_rate"))
    index = events.groupBy(F.date_trunc("day", "ts").alias("timestamp")).agg(
        F.floor(F.max("value")).cast("int").alias("fear_greed_value"), F.lit("Known").alias("fear_greed_class")
    )
    hours = events.groupBy(F.date_trunc("hour", "ts").alias("timestamp")).agg(
        F.count_if(kind == "view").alias("gdelt_econ_volume"),
        F.max(F.when(kind == "view", F.col("value"))).alias("gdelt_econ_tone"),
        F.count_if(kind == "error").alias("gdelt_conflict_volume"),
    )
    again = hours.where("hour(timestamp) % 4 = 0").withColumn("gdelt_econ_volume", F.col("gdelt_econ_volume") + 1)
    news = events.select("timestamp", F.col("props").alias("text_content"), F.col("event_id").alias("_line"))
    manifest = events.where("value > 5").select(kind.alias("asset"), F.unix_seconds(F.date_trunc("hour", "ts")).alias("unix_ts")).distinct()
    return Sources(bars(spark, folder), funding, index, hours.unionByName(again), news, manifest)


@query(
    "align",
    f"""WITH {BARS},
funding AS (SELECT event_type AS asset, ts, max(value) AS funding_rate FROM events GROUP BY 1, 2),
index_ AS (SELECT date_trunc('day', ts) AS ts, CAST(floor(max(value)) AS INTEGER) AS v FROM events GROUP BY 1),
hours AS (SELECT date_trunc('hour', ts) AS timestamp, count(*) FILTER (event_type = 'view') AS econ,
  max(value) FILTER (event_type = 'view') AS tone, count(*) FILTER (event_type = 'error') AS conflict FROM events GROUP BY 1),
macro AS (FROM hours UNION ALL SELECT timestamp, econ + 1, tone, conflict FROM hours WHERE hour(timestamp) % 4 = 0),
news AS (SELECT date_trunc('hour', ts) AS timestamp, coalesce(string_agg(props, ' [SEP] ' ORDER BY event_id), '') AS text_content
  FROM events GROUP BY 1),
charts AS (SELECT DISTINCT event_type AS asset, date_trunc('hour', ts) AS timestamp FROM events WHERE value > 5),
rated AS (SELECT b.*, f.funding_rate FROM bars b ASOF LEFT JOIN funding f ON b.asset = f.asset AND b.timestamp >= f.ts),
firsts AS (SELECT asset, min(timestamp) AS first FROM bars GROUP BY 1),
indexed AS (SELECT x.*, CASE WHEN i.ts >= first THEN i.v END AS fear_greed_value
  FROM rated x ASOF LEFT JOIN index_ i ON x.timestamp >= i.ts JOIN firsts ON firsts.asset = x.asset),
joined AS (SELECT x.*, econ, tone, conflict, row_number() OVER (PARTITION BY asset ORDER BY timestamp, econ NULLS FIRST) AS at_
  FROM indexed x LEFT JOIN macro USING (timestamp) WHERE timestamp BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
moves AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS change, (lead(close, 24) OVER w - close) / nullif(close, 0) AS ahead
  FROM joined WINDOW w AS (PARTITION BY asset ORDER BY at_)),
vols AS (SELECT *, stddev_samp(change) OVER (PARTITION BY asset ORDER BY at_ ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS vol FROM moves),
kept AS (SELECT *, ahead / (vol + 1e-6) AS target FROM vols SEMI JOIN charts USING (asset, timestamp) WHERE ahead IS NOT NULL AND vol IS NOT NULL),
numbered AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY asset) AS n,
  coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0) AS step FROM kept WINDOW w AS (PARTITION BY asset ORDER BY at_)),
labelled AS (SELECT *, {SPLIT_CASE} AS split FROM numbered)
SELECT asset, split, idx AS row_idx, {STAMP} AS timestamp, round(step, 4) + 0.0 AS return_1h, volume, funding_rate, fear_greed_value,
  coalesce(econ, 0) AS gdelt_econ_volume, coalesce(tone, 0) AS gdelt_econ_tone, coalesce(conflict, 0) AS gdelt_conflict_volume,
  coalesce(text_content, '{PLACEHOLDER}') AS text_content,
  'charts/' || asset || '/' || CAST(epoch(timestamp) AS BIGINT) || '.png' AS image_path, round(target, 4) + 0.0 AS target_score
FROM labelled LEFT JOIN news USING (timestamp) WHERE split NOT LIKE 'embargo%'""",
)
def align_query(spark, folder):
    out = published(align(_sources(spark, folder), START, END))
    return out.withColumns(
        {"timestamp": stamp("timestamp"), "return_1h": r("return_1h", 4), "target_score": r("target_score", 4)}
    )


@query(
    "chart_windows",
    f"""WITH RECURSIVE {BARS}, hourly AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp) - 1 AS row_idx FROM bars),
steps AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS s,
   avg(close) OVER (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7
   FROM hourly WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
e AS (SELECT asset, row_idx, greatest(s, 0) AS up, greatest(-s, 0) AS down, close AS f, close AS g FROM steps WHERE row_idx = 0
      UNION ALL
      SELECT d.asset, d.row_idx, greatest(d.s, 0) / 14 + e.up * 13 / 14, greatest(-d.s, 0) / 14 + e.down * 13 / 14,
             (2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.f, (2.0::DOUBLE / 27) * d.close + (1 - 2.0::DOUBLE / 27) * e.g
      FROM e JOIN steps d ON d.asset = e.asset AND d.row_idx = e.row_idx + 1),
ready AS (SELECT asset, row_idx, timestamp, close, ma7, f - g AS macd,
   CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM e JOIN steps USING (asset, row_idx) WHERE row_idx >= 33),
framed AS (SELECT asset, timestamp, list(close) OVER w AS closes, avg(rsi) OVER w AS rsi, avg(macd) OVER w AS macd, avg(ma7) OVER w AS ma7
   FROM ready WINDOW w AS (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT asset, {STAMP} AS timestamp, CAST(epoch(timestamp) AS BIGINT) AS unix_ts, 'charts/' || asset || '/' || CAST(epoch(timestamp) AS BIGINT) || '.png' AS image_path,
  len(closes) AS n, closes[1] AS first_close, closes[-1] AS last_close, round(rsi, 3) AS rsi, round(macd, 3) + 0.0 AS macd, round(ma7, 5) AS ma7
FROM framed WHERE len(closes) >= 12""",
)
def chart_windows_query(spark, folder):
    out = chart_windows(bars(spark, folder))
    mean = lambda c: F.aggregate("candles", F.lit(0.0), lambda acc, x: acc + x[c]) / F.size("candles")
    return out.select(
        "asset",
        stamp("timestamp").alias("timestamp"),
        "unix_ts",
        "image_path",
        F.size("candles").cast("long").alias("n"),
        F.col("candles")[0]["close"].alias("first_close"),
        F.element_at("candles", -1)["close"].alias("last_close"),
        r(mean("RSI"), 3).alias("rsi"),
        r(mean("MACD"), 3).alias("macd"),
        r(mean("MA7"), 5).alias("ma7"),
    )
