"""Queries over the bar series: as-of joins, labels, splits, indicators, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsalign.operators.asof import asof_backward, clip_to_range_of
from tsalign.operators.chunk import grid_index, row_index
from tsalign.operators.durable import durable
from tsalign.operators.density import density
from tsalign.operators.indicators import Ema, ema, indicators, lag_features, macd, rolling_mean, rsi, sma
from tsalign.operators.islands import cascades
from tsalign.operators.label import forward_return, pct_change, return_1h, rolling_vol, target_score
from tsalign.operators.scale import apply_scaler, fit_standard
from tsalign.operators.split import batches, chronological_split, embargo_audit, epoch_batches, label_split, round_keys
from tsalign.operators.windows import (
    candle_windows,
    flatten_window,
    gap_check,
    keep_last_n,
    lead_lag_corr,
    null_context,
    null_positions,
    running_best,
    sequence_windows,
    short_series,
)
from tsalign.operators.profile import embargo_check, split_summary
from tsalign.plans.registry import query
from tsalign.plans.tables import (
    BARS,
    DAILY,
    PREDICTIONS,
    RATES,
    SPLIT_CASE,
    STAMP,
    bars,
    daily,
    indexed_bars,
    indexed_daily,
    load,
    predictions,
    r,
    rates,
    stamp,
)

KEY = ["asset"]


# --- as-of, label and split -------------------------------------------------


@query(
    "aligned_target_split",
    f"""WITH {BARS}, {RATES},
joined AS (SELECT b.*, x.rate FROM bars b ASOF LEFT JOIN rates x ON b.timestamp >= x.ts),
moves AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS change,
                 (lead(close, 24) OVER w - close) / nullif(close, 0) AS ahead
          FROM joined WINDOW w AS (PARTITION BY asset ORDER BY timestamp)),
vols AS (SELECT *, stddev_samp(change) OVER (PARTITION BY asset ORDER BY timestamp
                                             ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS vol FROM moves),
labels_ AS (SELECT *, ahead / (vol + 1e-6) AS target FROM vols WHERE ahead IS NOT NULL AND vol IS NOT NULL),
indexed AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY asset) AS n,
                   coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0) AS step
            FROM labels_ WINDOW w AS (PARTITION BY asset ORDER BY timestamp))
SELECT asset, {STAMP} AS timestamp, idx AS row_idx, rate AS funding_rate, round(step, 4) + 0.0 AS return_1h,
       round(target, 4) + 0.0 AS target_score, {SPLIT_CASE} AS split FROM indexed""",
)
def aligned_target_split(spark, folder):
    joined = asof_backward(bars(spark, folder), rates(spark, folder), "timestamp", values=["rate"], order=["event_id"])
    # An index reads its input twice, so each is built over written files.
    joined = durable(joined.select("asset", "timestamp", "hour_no", "close", "rate"), "joined")
    labelled = durable(target_score(grid_index(joined, KEY, "hour_no"), KEY, "row_idx", pad=False), "labelled")
    final = grid_index(labelled, KEY, "row_idx", total="n_rows")
    split = label_split(return_1h(final, KEY, "row_idx", pad=False), "row_idx", "n_rows")
    return split.select(
        "asset",
        stamp("timestamp").alias("timestamp"),
        "row_idx",
        F.col("rate").alias("funding_rate"),
        r("return_1h", 4).alias("return_1h"),
        r("target_score", 4).alias("target_score"),
        "split",
    )


@query(
    "asof_rate",
    """WITH views AS (SELECT user_id, ts, last(value ORDER BY event_id) AS rate FROM events
                  WHERE event_type = 'view' GROUP BY 1, 2)
SELECT e.event_id, v.rate FROM events e ASOF LEFT JOIN views v ON e.user_id = v.user_id AND e.ts >= v.ts""",
)
def asof_rate(spark, folder):
    """Every event with its user's latest view."""
    events = load(spark, folder, "events")
    views = events.where(F.col("event_type") == "view").select("user_id", "ts", "event_id", F.col("value").alias("rate"))
    left = events.select("event_id", "user_id", "ts")
    return asof_backward(left, views, "ts", ["user_id"], ["rate"], ["event_id"]).select("event_id", "rate")


@query(
    "asof_clipped",
    f"""WITH {BARS}, {RATES},
firsts AS (SELECT asset, min(timestamp) AS first_bar FROM bars GROUP BY 1),
joined AS (SELECT b.*, x.rate, x.ts FROM bars b ASOF LEFT JOIN rates x ON b.timestamp >= x.ts)
SELECT asset, {STAMP} AS timestamp, CASE WHEN ts >= first_bar THEN rate END AS rate
FROM joined JOIN firsts USING (asset)""",
)
def asof_clipped(spark, folder):
    out = asof_backward(
        bars(spark, folder), rates(spark, folder), "timestamp", values=["rate"], order=["event_id"], clip_by=KEY
    )
    return out.select("asset", stamp("timestamp").alias("timestamp"), "rate")


@query(
    "clip_to_range",
    f"""WITH {BARS}, {RATES},
span AS (SELECT min(timestamp) AS a, max(timestamp) AS b FROM bars)
SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, rate FROM rates, span WHERE ts BETWEEN a AND b""",
)
def clip_to_range(spark, folder):
    out = clip_to_range_of(rates(spark, folder), bars(spark, folder), "timestamp")
    return out.select(stamp("timestamp").alias("timestamp"), "rate")


def _target_sql(score: str) -> str:
    return f"""WITH {{table}},
moves AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS change,
                 (lead(close, 24) OVER w - close) / nullif(close, 0) AS ahead
          FROM {{name}} WINDOW w AS (PARTITION BY asset ORDER BY {{on}})),
vols AS (SELECT *, stddev_samp(change) OVER (PARTITION BY asset ORDER BY {{on}}
                                             ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS vol FROM moves),
scored AS (SELECT *, {score} AS score FROM vols)
SELECT asset, {{key}}, round(score, 4) + 0.0 AS target_score FROM scored WHERE score IS NOT NULL"""


@query(
    "target_raw",
    _target_sql("ahead / (vol + 1e-6)").format(table=DAILY, name="daily", on="day", key="CAST(day AS VARCHAR) AS day"),
)
def target_raw(spark, folder):
    out = target_score(indexed_daily(spark, folder), KEY, "row_idx", pad=False)
    return out.select("asset", F.col("day").cast("string").alias("day"), r("target_score", 4).alias("target_score"))


@query(
    "target_tanh",
    _target_sql("tanh(ahead / nullif(1.5 * vol, 0)) * 100").format(
        table=BARS, name="bars", on="timestamp", key=f"{STAMP} AS timestamp"
    ),
)
def target_tanh(spark, folder):
    out = target_score(indexed_bars(spark, folder), KEY, "row_idx", mode="tanh", pad=False)
    return out.select("asset", stamp("timestamp").alias("timestamp"), r("target_score", 4).alias("target_score"))


@query(
    "returns",
    f"""WITH {DAILY},
holed AS (SELECT asset, row_idx, CASE WHEN volume % 5 <> 0 THEN close END AS close FROM daily),
padded AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY row_idx
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM holed),
stepped AS (SELECT asset, row_idx, filled / nullif(lag(filled) OVER w, 0) - 1 AS change
            FROM padded WINDOW w AS (PARTITION BY asset ORDER BY row_idx))
SELECT asset, row_idx, round(change, 6) + 0.0 AS change, round(coalesce(change * 100, 0), 4) + 0.0 AS return_1h FROM stepped""",
)
def returns(spark, folder):
    """Days whose order count is a multiple of five lose their close, to exercise padding."""
    holed = indexed_daily(spark, folder).select(
        "asset", "row_idx", F.when(F.col("volume") % 5 != 0, F.col("close")).alias("close")
    )
    out = return_1h(pct_change(holed, KEY, "row_idx", "close", "change"), KEY, "row_idx")
    return out.select("asset", "row_idx", r("change").alias("change"), r("return_1h", 4).alias("return_1h"))


@query(
    "rolling_vol",
    f"""WITH {DAILY},
moves AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS change
          FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day))
SELECT asset, row_idx, round(stddev_samp(change) OVER (PARTITION BY asset ORDER BY day
       ROWS BETWEEN 167 PRECEDING AND CURRENT ROW), 6) AS volatility FROM moves""",
)
def rolling_vol_query(spark, folder):
    moved = pct_change(indexed_daily(spark, folder), KEY, "row_idx", "close", "change", pad=False)
    out = rolling_vol(moved, KEY, "row_idx", "change")
    return out.select("asset", "row_idx", F.round("volatility", 6).alias("volatility"))


@query(
    "forward_return",
    f"""WITH {DAILY}
SELECT asset, row_idx, round((lead(close, 24) OVER w - close) / nullif(close, 0), 6) + 0.0 AS forward_return
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day)""",
)
def forward_return_query(spark, folder):
    out = forward_return(indexed_daily(spark, folder), KEY, "row_idx", "close")
    return out.select("asset", "row_idx", r("forward_return").alias("forward_return"))


_SPLIT = f"""indexed AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY timestamp) - 1 AS idx,
       count(*) OVER (PARTITION BY asset) AS n FROM bars),
parts AS (SELECT *, {SPLIT_CASE} AS split FROM indexed)"""


@query("split_labels", f"WITH {BARS}, {_SPLIT} SELECT asset, {STAMP} AS timestamp, idx AS row_idx, split FROM parts")
def split_labels(spark, folder):
    out = chronological_split(bars(spark, folder), KEY, "hour_no")
    return out.select("asset", stamp("timestamp").alias("timestamp"), "row_idx", "split")


@query(
    "split_summary",
    f"""WITH {BARS}, {_SPLIT}
SELECT asset, split, count(*) AS n, strftime(min(timestamp), '%Y-%m-%d %H:%M:%S') AS first,
       strftime(max(timestamp), '%Y-%m-%d %H:%M:%S') AS last,
       (epoch(max(timestamp)) - epoch(min(timestamp))) / 3600 AS duration_hours,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY asset), 4) AS share_pct
FROM parts GROUP BY asset, split""",
)
def split_summary_query(spark, folder):
    out = split_summary(chronological_split(bars(spark, folder), KEY, "hour_no"), by=["asset", "split"])
    return out.select(
        "asset",
        "split",
        "n",
        stamp("first").alias("first"),
        stamp("last").alias("last"),
        "duration_hours",
        F.round("share_pct", 4).alias("share_pct"),
    )


@query(
    "embargo_check",
    f"""WITH {BARS}, {_SPLIT},
edges AS (SELECT asset, max(epoch(timestamp)) FILTER (split = 'train') AS t1,
                 min(epoch(timestamp)) FILTER (split = 'validation') AS v0,
                 max(epoch(timestamp)) FILTER (split = 'validation') AS v1,
                 min(epoch(timestamp)) FILTER (split = 'test_in_domain') AS s0 FROM parts GROUP BY asset)
SELECT asset, (v0 - t1) / 3600 AS embargo_1_hours, (v0 - t1) / 3600 >= 24 AS embargo_1_ok,
       (s0 - v1) / 3600 AS embargo_2_hours, (s0 - v1) / 3600 >= 24 AS embargo_2_ok, t1 < v0 AND v1 < s0 AS ordered
FROM edges""",
)
def embargo_check_query(spark, folder):
    return embargo_check(chronological_split(bars(spark, folder), KEY, "hour_no"), by=KEY)


@query(
    "embargo_audit",
    f"""WITH {BARS}, {_SPLIT},
inside AS (SELECT asset, timestamp, split, row_number() OVER (PARTITION BY asset, split ORDER BY timestamp) AS hour_number
           FROM parts WHERE split LIKE 'embargo%')
SELECT asset, {STAMP} AS timestamp, split, hour_number FROM inside WHERE (hour_number - 1) % 6 = 0""",
)
def embargo_audit_query(spark, folder):
    indexed = grid_index(bars(spark, folder), KEY, "hour_no", total="n_rows")
    out = embargo_audit(indexed, "row_idx", "n_rows")
    return out.select("asset", stamp("timestamp").alias("timestamp"), "split", "hour_number")


@query(
    "row_index",
    """SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS row_idx
FROM events""",
)
def row_index_query(spark, folder):
    events = load(spark, folder, "events").select("event_id", "event_type", "ts")
    return row_index(events, ["event_type"], ["ts", "event_id"]).select("event_id", "event_type", "row_idx")


@query(
    "row_index_nulls",
    """WITH e AS (SELECT event_id, CASE WHEN user_id % 7 <> 0 THEN event_type END AS kind, ts FROM events)
SELECT event_id, kind, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) - 1 AS row_idx,
  count(*) OVER (PARTITION BY kind) AS total FROM e""",
)
def row_index_nulls(spark, folder):
    kind = F.when(F.col("user_id") % 7 != 0, F.col("event_type"))
    events = load(spark, folder, "events").select("event_id", kind.alias("kind"), "ts")
    return row_index(events, ["kind"], ["ts", "event_id"], total="total").drop("ts")


@query(
    "grid_index_nulls",
    """WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS kind, CASE WHEN o_custkey % 5 <> 0 THEN o_orderkey END AS pos FROM orders)
SELECT o_orderkey, kind, CASE WHEN pos IS NOT NULL THEN
  count(pos) OVER (PARTITION BY kind ORDER BY pos NULLS FIRST ROWS UNBOUNDED PRECEDING) - 1 END AS row_idx FROM o""",
)
def grid_index_nulls(spark, folder):
    orders = load(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("kind"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderkey")).alias("pos"),
    )
    return grid_index(orders, ["kind"], "pos").select("o_orderkey", "kind", "row_idx")


@query(
    "batches",
    f"""WITH {PREDICTIONS},
numbered AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS place, count(*) OVER () AS n FROM pred)
SELECT idx, CAST(floor(place / 128) AS BIGINT) AS batch_idx FROM numbered WHERE floor(place / 128) < floor(n / 128)""",
)
def batches_query(spark, folder):
    return batches(predictions(spark, folder), "idx", 128, drop_last=True).select("idx", "batch_idx")


@query(
    "batches_shuffled",
    f"""WITH {PREDICTIONS},
numbered AS (SELECT idx, row_number() OVER (ORDER BY ('0x' || substr(md5('42:' || idx), 1, 15))::BIGINT, idx) - 1 AS place,
                    count(*) OVER () AS n FROM pred)
SELECT idx, CAST(floor(place / 128) AS BIGINT) AS batch_idx FROM numbered WHERE floor(place / 128) < floor(n / 128)""",
)
def batches_shuffled(spark, folder):
    """The seeded shuffle of the training batches."""
    return batches(predictions(spark, folder).select("idx"), "idx", 128, drop_last=True, seed=42)


def _shuffled_place(epoch):
    keys = ", ".join(f"{{'x': 0::BIGINT, 'k': {k}::BIGINT, 'a': {a}::BIGINT, 'b': {b}::BIGINT, 'c': {c}::BIGINT}}" for k, a, b, c in round_keys(42, epoch))
    mirror, prime = "((r.k % n + n - s.x) % n)", 2**31 - 1
    z = f"((greatest(s.x, {mirror}) % {prime} * r.a + r.b) % {prime})"
    step = f"{{'x': CASE WHEN ((({z} * {z} + r.c) % {prime}) >> 16) % 2 = 1 THEN {mirror} ELSE s.x END, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT}}"
    first = "{'x': spot, 'k': 0::BIGINT, 'a': 0::BIGINT, 'b': 0::BIGINT, 'c': 0::BIGINT}"
    return f"list_reduce(list_concat([{first}], [{keys}]), lambda s, r: {step}).x"


@query(
    "epoch_batches",
    f"""WITH {PREDICTIONS},
numbered AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS spot, count(*) OVER () AS n FROM pred),
placed AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, idx, n, {_shuffled_place(e)} AS place FROM numbered" for e in (0, 1))})
SELECT epoch, idx, CAST(place // 128 AS BIGINT) AS batch_idx, CAST(place % 128 AS INTEGER) AS in_batch FROM placed WHERE place // 128 < n // 128""",
)
def epoch_batches_query(spark, folder):
    """Two epochs of shuffled batches over one index."""
    indexed = durable(row_index(predictions(spark, folder).select("idx"), [], ["idx"], "at", total="n"), "indexed")
    epochs = [epoch_batches(indexed, "at", "n", 128, epoch).select(F.lit(epoch).alias("epoch"), "idx", "batch_idx", "in_batch") for epoch in (0, 1)]
    return epochs[0].unionByName(epochs[1])


# --- indicators -------------------------------------------------------------


@query(
    "sma",
    f"""WITH {DAILY}
SELECT asset, row_idx,
  round(avg(close) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS "MA7",
  round(avg(close) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 4) AS "MA25"
FROM daily""",
)
def sma_query(spark, folder):
    out = sma(indexed_daily(spark, folder), KEY, "row_idx", "close", {"MA7": 7, "MA25": 25})
    return out.select("asset", "row_idx", F.round("MA7", 4).alias("MA7"), F.round("MA25", 4).alias("MA25"))


@query(
    "ema",
    f"""WITH RECURSIVE {DAILY},
e AS (SELECT asset, row_idx, close AS y FROM daily WHERE row_idx = 0
      UNION ALL
      SELECT d.asset, d.row_idx, (2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.y
      FROM e JOIN daily d ON d.asset = e.asset AND d.row_idx = e.row_idx + 1)
SELECT asset, row_idx, CASE WHEN row_idx >= 11 THEN round(y, 4) END AS ema FROM e""",
)
def ema_query(spark, folder):
    out = ema(durable(indexed_daily(spark, folder), "daily"), KEY, "row_idx", [Ema.span("close", "ema", 12, 12)])
    return out.select("asset", "row_idx", F.round("ema", 4).alias("ema"))


@query(
    "rsi",
    f"""WITH RECURSIVE {DAILY},
steps AS (SELECT asset, row_idx, coalesce(close - lag(close) OVER (PARTITION BY asset ORDER BY row_idx), 0) AS s FROM daily),
e AS (SELECT asset, row_idx, greatest(s, 0) AS up, greatest(-s, 0) AS down FROM steps WHERE row_idx = 0
      UNION ALL
      SELECT d.asset, d.row_idx, greatest(d.s, 0) / 14 + e.up * 13 / 14, greatest(-d.s, 0) / 14 + e.down * 13 / 14
      FROM e JOIN steps d ON d.asset = e.asset AND d.row_idx = e.row_idx + 1)
SELECT asset, row_idx, CASE WHEN row_idx >= 13 THEN round(CASE WHEN down = 0 THEN 100
       ELSE 100 - 100 / (1 + up / down) END, 4) END AS "RSI" FROM e""",
)
def rsi_query(spark, folder):
    out = rsi(durable(indexed_daily(spark, folder), "daily"), KEY, "row_idx")
    return out.select("asset", "row_idx", F.round("RSI", 4).alias("RSI"))


@query(
    "macd",
    f"""WITH RECURSIVE {DAILY},
e AS (SELECT asset, row_idx, close AS f, close AS s, NULL::DOUBLE AS g FROM daily WHERE row_idx = 0
      UNION ALL
      SELECT d.asset, d.row_idx, (2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.f,
             (2.0::DOUBLE / 27) * d.close + (1 - 2.0::DOUBLE / 27) * e.s,
             CASE WHEN d.row_idx >= 25 THEN
               CASE WHEN e.g IS NULL
                    THEN (2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.f
                         - ((2.0::DOUBLE / 27) * d.close + (1 - 2.0::DOUBLE / 27) * e.s)
                    ELSE 0.2::DOUBLE * ((2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.f
                         - ((2.0::DOUBLE / 27) * d.close + (1 - 2.0::DOUBLE / 27) * e.s)) + 0.8::DOUBLE * e.g END END
      FROM e JOIN daily d ON d.asset = e.asset AND d.row_idx = e.row_idx + 1)
SELECT asset, row_idx, CASE WHEN row_idx >= 25 THEN round(f - s, 4) + 0.0 END AS "MACD",
       CASE WHEN row_idx >= 33 THEN round(g, 4) + 0.0 END AS "MACD_signal",
       CASE WHEN row_idx >= 33 THEN round(f - s - g, 4) + 0.0 END AS "MACD_hist" FROM e""",
)
def macd_query(spark, folder):
    out = macd(durable(indexed_daily(spark, folder), "daily"), KEY, "row_idx")
    return out.select("asset", "row_idx", *[r(c, 4).alias(c) for c in ("MACD", "MACD_signal", "MACD_hist")])


@query(
    "candle_windows",
    f"""WITH {BARS},
framed AS (SELECT asset, timestamp, list(close) OVER w AS closes, list(volume) OVER w AS volumes FROM bars
           WINDOW w AS (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT asset, {STAMP} AS timestamp, len(closes) AS n, closes[1] AS first_close, closes[-1] AS last_close,
       CAST(list_sum(volumes) AS BIGINT) AS volume FROM framed WHERE len(closes) >= 12""",
)
def candle_windows_query(spark, folder):
    out = candle_windows(indexed_bars(spark, folder), KEY, "row_idx", ["open", "high", "low", "close", "volume"])
    return out.select(
        "asset",
        stamp("timestamp").alias("timestamp"),
        F.size("candles").cast("long").alias("n"),
        F.col("candles")[0]["close"].alias("first_close"),
        F.element_at("candles", -1)["close"].alias("last_close"),
        F.aggregate("candles", F.lit(0).cast("long"), lambda acc, x: acc + x["volume"]).alias("volume"),
    )


@query(
    "indicator_windows",
    f"""WITH RECURSIVE {DAILY},
steps AS (SELECT *, coalesce(close - lag(close) OVER w, 0) AS s,
   avg(close) OVER (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS ma7
   FROM daily WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
e AS (SELECT asset, row_idx, greatest(s, 0) AS up, greatest(-s, 0) AS down, close AS f, close AS g FROM steps WHERE row_idx = 0
      UNION ALL
      SELECT d.asset, d.row_idx, greatest(d.s, 0) / 14 + e.up * 13 / 14, greatest(-d.s, 0) / 14 + e.down * 13 / 14,
             (2.0::DOUBLE / 13) * d.close + (1 - 2.0::DOUBLE / 13) * e.f, (2.0::DOUBLE / 27) * d.close + (1 - 2.0::DOUBLE / 27) * e.g
      FROM e JOIN steps d ON d.asset = e.asset AND d.row_idx = e.row_idx + 1),
ready AS (SELECT asset, row_idx, day, close, ma7, f - g AS macd,
   CASE WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END AS rsi FROM e JOIN steps USING (asset, row_idx) WHERE row_idx >= 33),
framed AS (SELECT asset, day, list(close) OVER w AS closes, avg(rsi) OVER w AS rsi, avg(macd) OVER w AS macd, avg(ma7) OVER w AS ma7
   FROM ready WINDOW w AS (PARTITION BY asset ORDER BY row_idx ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT asset, CAST(day AS VARCHAR) AS day, len(closes) AS n, round(rsi, 4) AS rsi, round(macd, 4) + 0.0 AS macd, round(ma7, 5) AS ma7
FROM framed WHERE len(closes) >= 12""",
)
def indicator_windows(spark, folder):
    """Indicators on the whole series, warm-up rows dropped, then candle windows: the chart inputs."""
    ready = indicators(durable(indexed_daily(spark, folder), "daily"), KEY, "row_idx").na.drop("any")
    ready = grid_index(durable(ready, "indicators"), KEY, "row_idx", "at")
    cols = ["open", "high", "low", "close", "volume", "MA7", "MA25", "RSI", "MACD", "MACD_signal", "MACD_hist"]
    out = candle_windows(ready, KEY, "at", cols)
    mean = lambda c: F.aggregate("candles", F.lit(0.0), lambda acc, x: acc + x[c]) / F.size("candles")
    return out.select(
        "asset",
        F.col("day").cast("string").alias("day"),
        F.size("candles").cast("long").alias("n"),
        F.round(mean("RSI"), 4).alias("rsi"),
        r(mean("MACD"), 4).alias("macd"),
        F.round(mean("MA7"), 5).alias("ma7"),
    )


@query(
    "sequence_windows",
    """WITH framed AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rn, vec_id, label,
   list(embedding) OVER (ORDER BY vec_id ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq FROM embeddings)
SELECT rn - 24 AS idx, vec_id, label AS target, len(flatten(seq)) AS width,
       round(list_sum(flatten(seq)::DOUBLE[]), 4) + 0.0 AS total FROM framed WHERE rn >= 24""",
)
def sequence_windows_query(spark, folder):
    vectors = grid_index(load(spark, folder, "embeddings"), [], "vec_id")
    out = flatten_window(sequence_windows(vectors, [], "row_idx", ["embedding"], "label", ["vec_id"]), "embedding", "flat")
    total = F.aggregate("flat", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return out.select("idx", "vec_id", "target", F.size("flat").cast("long").alias("width"), r(total, 4).alias("total"))


@query(
    "bar_windows",
    f"""WITH {BARS},
framed AS (SELECT asset, timestamp, close, row_number() OVER w0 - 1 AS rn,
   list(close) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq
   FROM bars WINDOW w0 AS (PARTITION BY asset ORDER BY timestamp))
SELECT asset, rn - 24 AS idx, {STAMP} AS timestamp, len(seq) AS n, seq[1] AS first_close, seq[-1] AS last_close,
       round(list_sum(seq), 4) AS total, close AS target FROM framed WHERE rn >= 24""",
)
def bar_windows(spark, folder):
    out = sequence_windows(indexed_bars(spark, folder), KEY, "row_idx", ["close"], "close", ["timestamp"])
    return out.select(
        "asset",
        "idx",
        stamp("timestamp").alias("timestamp"),
        F.size("close").cast("long").alias("n"),
        F.col("close")[0].alias("first_close"),
        F.element_at("close", -1).alias("last_close"),
        F.round(F.aggregate("close", F.lit(0.0), lambda acc, x: acc + x), 4).alias("total"),
        "target",
    )


@query(
    "bar_windows_holes",
    f"""WITH {BARS},
framed AS (SELECT asset, timestamp, row_number() OVER w0 - 1 AS rn, CASE WHEN volume % 3 <> 0 THEN close END AS target,
   list(CASE WHEN volume % 3 <> 0 THEN close END) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS seq
   FROM bars WINDOW w0 AS (PARTITION BY asset ORDER BY timestamp))
SELECT asset, rn - 24 AS idx, len(seq) AS n, len(list_filter(seq, lambda x: x IS NULL)) AS holes,
  seq[1] AS first_close, seq[-1] AS last_close, target FROM framed WHERE rn >= 24""",
)
def bar_windows_holes(spark, folder):
    bars_ = indexed_bars(spark, folder).withColumn("close", F.when(F.col("volume") % 3 != 0, F.col("close")))
    out = sequence_windows(bars_, KEY, "row_idx", ["close"], "close")
    return out.select(
        "asset",
        "idx",
        F.size("close").cast("long").alias("n"),
        F.size(F.filter("close", lambda x: x.isNull())).cast("long").alias("holes"),
        F.col("close")[0].alias("first_close"),
        F.element_at("close", -1).alias("last_close"),
        "target",
    )


@query(
    "short_series",
    "SELECT CAST(o_custkey AS BIGINT) AS o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) <= 10",
)
def short_series_query(spark, folder):
    return short_series(load(spark, folder, "orders"), ["o_custkey"], 10)


@query(
    "lag_features",
    f"""WITH {DAILY}
SELECT asset, row_idx, lag(close, 1) OVER w AS close_lag_1, lag(close, 24) OVER w AS close_lag_24,
       lag(volume, 1) OVER w AS volume_lag_1, lag(volume, 24) OVER w AS volume_lag_24,
       round(avg(close) OVER (PARTITION BY asset ORDER BY day ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 4) AS close_mean_10
FROM daily WINDOW w AS (PARTITION BY asset ORDER BY day)""",
)
def lag_features_query(spark, folder):
    out = lag_features(indexed_daily(spark, folder), KEY, "row_idx", ["close", "volume"], [1, 24])
    out = rolling_mean(out, KEY, "row_idx", ["close"], 10)
    lags = [f"{c}_lag_{k}" for c in ("close", "volume") for k in (1, 24)]
    return out.select("asset", "row_idx", *lags, F.round("close_mean_10", 4).alias("close_mean_10"))


def _corr_sql(k: int) -> str:
    return f"""SELECT asset, {k} AS lag, count(*) AS n,
  round(coalesce(covar_pop(a, b) / nullif(sqrt(var_pop(a) * var_pop(b)), 0), 0), 6) + 0.0 AS corr
  FROM (SELECT asset, lag(volume, {k}) OVER (PARTITION BY asset ORDER BY day) AS a, close AS b FROM daily)
  WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY asset"""


@query("lead_lag_corr", f"WITH {DAILY} " + " UNION ALL ".join(_corr_sql(k) for k in (1, 2, 24)))
def lead_lag_corr_query(spark, folder):
    out = lead_lag_corr(indexed_daily(spark, folder), KEY, "row_idx", "volume", "close", [1, 2, 24])
    return out.select("asset", "lag", "n", r("corr").alias("corr"))


# --- gaps, nulls and histories ----------------------------------------------


@query(
    "gap_check",
    f"""WITH {BARS},
gaps AS (SELECT asset, timestamp, (hour_no - lag(hour_no) OVER (PARTITION BY asset ORDER BY hour_no))::DOUBLE AS gap_hours FROM bars)
SELECT asset, {STAMP} AS timestamp, gap_hours FROM gaps WHERE gap_hours > 1""",
)
def gap_check_query(spark, folder):
    out = gap_check(indexed_bars(spark, folder), KEY, "row_idx")
    return out.select("asset", stamp("timestamp").alias("timestamp"), "gap_hours")


_HOLED = f"""{DAILY},
holed AS (SELECT asset, row_idx, CASE WHEN volume <> 4 THEN close END AS close FROM daily)"""


def _holed(spark, folder):
    return indexed_daily(spark, folder).select(
        "asset", "row_idx", F.when(F.col("volume") != 4, F.col("close")).alias("close")
    )


@query(
    "null_context",
    f"""WITH {_HOLED},
firsts AS (SELECT asset, min(row_idx) AS f FROM holed WHERE close IS NULL GROUP BY 1)
SELECT asset, row_idx, close, close IS NULL AS is_null FROM holed JOIN firsts USING (asset) WHERE abs(row_idx - f) <= 2""",
)
def null_context_query(spark, folder):
    return null_context(_holed(spark, folder), KEY, "row_idx", "close")


_NULL_KEY = "nullif(asset, '2-HIGH')"


@query(
    "null_context_nulls",
    f"""WITH {_HOLED},
named AS (SELECT {_NULL_KEY} AS asset, row_idx, close FROM holed),
firsts AS (SELECT asset, min(row_idx) AS f FROM named WHERE close IS NULL GROUP BY 1)
SELECT n.asset, row_idx, close, close IS NULL AS is_null FROM named n JOIN firsts q ON n.asset IS NOT DISTINCT FROM q.asset WHERE abs(row_idx - f) <= 2""",
)
def null_context_nulls(spark, folder):
    """One of the series has no name."""
    named = _holed(spark, folder).withColumn("asset", F.expr(_NULL_KEY))
    return null_context(named, KEY, "row_idx", "close")


@query(
    "scale_nulls",
    f"""WITH {DAILY}, named AS (SELECT {_NULL_KEY} AS asset, row_idx, close FROM daily),
s AS (SELECT asset, avg(close) AS a, stddev_pop(close) AS d FROM named GROUP BY 1)
SELECT n.asset, row_idx, round((close - a) / d, 5) + 0.0 AS close_scaled FROM named n JOIN s ON n.asset IS NOT DISTINCT FROM s.asset""",
)
def scale_nulls(spark, folder):
    named = indexed_daily(spark, folder).select(F.expr(_NULL_KEY).alias("asset"), "row_idx", "close")
    out = apply_scaler(named, fit_standard(named, ["close"], KEY), ["close"], KEY)
    return out.select("asset", "row_idx", r("close_scaled", 5).alias("close_scaled"))


_RUNS = f"""{DAILY}, hot AS (SELECT {_NULL_KEY} AS asset, row_idx, close FROM daily WHERE close >= 200000),
started AS (SELECT *, coalesce(row_idx - lag(row_idx) OVER (PARTITION BY asset ORDER BY row_idx) > 3, true) AS starts FROM hot),
runs AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY asset ORDER BY row_idx) AS run FROM started)"""


@query(
    "cascades",
    f"""WITH {_RUNS} SELECT asset, min(row_idx) AS first, max(row_idx) AS last, count(*) AS n_rows, round(sum(close), 2) AS total, max(close) AS peak
FROM runs GROUP BY asset, run HAVING count(*) >= 2""",
)
def cascades_query(spark, folder):
    """Days of large orders that follow each other with at most two days between, in chunks of 64 days."""
    named = indexed_daily(spark, folder).withColumn("asset", F.expr(_NULL_KEY))
    out = cascades(named, KEY, "row_idx", "close", 200000, least_rows=2, bridge=2, rows=64)
    return out.withColumn("total", F.round("total", 2))


@query(
    "density",
    f"""WITH {DAILY}, long AS (SELECT asset, 'close' AS feature, close::DOUBLE AS v FROM daily UNION ALL SELECT asset, 'volume', volume::DOUBLE FROM daily),
s AS (SELECT asset, feature, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * count(*) ** -0.2 AS h FROM long GROUP BY 1, 2),
g AS (SELECT *, lo - 2 * h AS start, (hi - lo + 4 * h) / 32 AS step FROM s),
b AS (SELECT asset, feature, floor((v - start) / step + 0.5)::INTEGER AS bin, count(*) AS c FROM long JOIN g USING (asset, feature) GROUP BY 1, 2, 3),
p AS (SELECT *, unnest(range(0, 33)) AS point FROM g)
SELECT asset, feature, point::INTEGER AS point, round(any_value(start + point * step), 4) AS x,
  round(sum(c * exp(-0.5 * ((point - bin) * step / h) ** 2)) / any_value(n * h * sqrt(2 * pi())) * 1e6, 3) + 0.0 AS density
FROM p JOIN b USING (asset, feature) GROUP BY asset, feature, point""",
)
def density_query(spark, folder):
    out = density(daily(spark, folder), KEY, ["close", "volume"], points=33)
    return out.select("asset", "feature", "point", F.round("x", 4).alias("x"), r(F.col("density") * 1e6, 3).alias("density"))


@query(
    "null_positions",
    f"""WITH {_HOLED}
SELECT asset, row_idx FROM holed WHERE close IS NULL""",
)
def null_positions_query(spark, folder):
    return null_positions(_holed(spark, folder), KEY, "row_idx", "close")


HISTORY = f"""{PREDICTIONS},
history AS (SELECT run, epoch, avg((prediction - target) * (prediction - target)) AS val_mse FROM pred GROUP BY 1, 2)"""


def history(spark, folder):
    """Validation loss per run and epoch."""
    error = F.col("prediction") - F.col("target")
    return predictions(spark, folder).groupBy("run", "epoch").agg(F.avg(error * error).alias("val_mse"))


@query(
    "running_best",
    f"""WITH {HISTORY},
best AS (SELECT *, min(val_mse) OVER (PARTITION BY run ORDER BY epoch
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM history)
SELECT run, epoch, round(best_before, 5) AS best_before, coalesce(val_mse < best_before, true) AS improved FROM best""",
)
def running_best_query(spark, folder):
    out = running_best(grid_index(history(spark, folder), ["run"], "epoch"), ["run"], "row_idx")
    return out.select("run", "epoch", F.round("best_before", 5).alias("best_before"), "improved")


@query(
    "keep_last_n",
    """SELECT o_custkey, o_orderkey,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) <= 3 AS keep FROM orders""",
)
def keep_last_n_query(spark, folder):
    orders = load(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return keep_last_n(orders, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "keep")


@query(
    "ema_holes",
    f"""WITH RECURSIVE {_HOLED},
obs AS (SELECT asset, row_idx, close, row_number() OVER w - 1 AS o, row_idx - lag(row_idx) OVER w AS gap
  FROM holed WHERE close IS NOT NULL WINDOW w AS (PARTITION BY asset ORDER BY row_idx)),
e AS (SELECT asset, row_idx, o, close AS y FROM obs WHERE o = 0
  UNION ALL
  SELECT d.asset, d.row_idx, d.o, (pow(11.0::DOUBLE / 13, d.gap) * e.y + (2.0::DOUBLE / 13) * d.close) / (pow(11.0::DOUBLE / 13, d.gap) + 2.0::DOUBLE / 13)
  FROM e JOIN obs d ON d.asset = e.asset AND d.o = e.o + 1),
filled AS (SELECT asset, row_idx, last_value(y IGNORE NULLS) OVER w AS y, last_value(o IGNORE NULLS) OVER w AS o
  FROM holed LEFT JOIN e USING (asset, row_idx) WINDOW w AS (PARTITION BY asset ORDER BY row_idx ROWS UNBOUNDED PRECEDING))
SELECT asset, row_idx, CASE WHEN o >= 11 THEN round(y, 4) END AS ema FROM filled""",
)
def ema_holes(spark, folder):
    holed = durable(_holed(spark, folder), "holed")
    out = ema(holed, KEY, "row_idx", [Ema.span("close", "ema", 12, 12)], holes=True)
    return out.select("asset", "row_idx", F.round("ema", 4).alias("ema"))


@query(
    "momentum",
    f"""WITH {DAILY}
SELECT asset, row_idx, round(close / nullif(lag(close, 10) OVER (PARTITION BY asset ORDER BY row_idx), 0) - 1, 6) + 0.0 AS momentum FROM daily""",
)
def momentum(spark, folder):
    out = pct_change(indexed_daily(spark, folder), KEY, "row_idx", "close", "momentum", pad=False, periods=10)
    return out.select("asset", "row_idx", r("momentum").alias("momentum"))
