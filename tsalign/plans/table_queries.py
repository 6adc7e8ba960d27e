"""Queries over table quality, scaling, metrics and verification."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tsalign.operators.chunk import grid_index
from tsalign.operators.durable import durable
from tsalign.operators.joins import compare_to_claims
from tsalign.operators.metrics import batch_mean_metrics, best_epoch, error_table, regression_metrics
from tsalign.operators.profile import (
    bounds_check,
    boxplot_stats,
    describe,
    histogram,
    image_sample_report,
    moments,
    null_profile,
    outlier_counts,
    outlier_flags,
    row_counts,
    source_coverage,
    target_profile,
    ttest_ind,
)
from tsalign.operators.quantile import melt
from tsalign.operators.scale import apply_scaler, fit_robust, fit_standard
from tsalign.operators.split import batches, chronological_split
from tsalign.operators.validate import batch_ok, validate_fear_greed, validate_news, validate_posts, violation_counts
from tsalign.operators.label import return_1h, target_score
from tsalign.plans.align import published
from tsalign.plans.registry import query
from tsalign.plans.series_queries import HISTORY, history
from tsalign.plans.tables import BARS, PREDICTIONS, SPLIT_CASE, load, predictions, r, stamp
from tsalign.plans.text_queries import PLACEHOLDER, _filled, HOURLY
from tsalign.plans.training import feature_tables, training_windows
from tsalign.plans.verify import verify_dataset

FLAG = ["l_returnflag"]
COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _long(table: str, keys: str, cols: list[str]) -> str:
    """Rows ``(keys, feature, value)`` in SQL."""
    return " UNION ALL ".join(f"SELECT {keys}, '{c}' AS feature, {c} AS value FROM {table}" for c in cols)


LONG = f"long AS ({_long('lineitem', 'l_returnflag', COLS)})"


# --- profiles ---------------------------------------------------------------


@query(
    "null_profile",
    f"""WITH long AS ({_long("(SELECT l_returnflag, nullif(l_discount, 0) AS discount, nullif(l_tax, 0) AS tax, l_quantity FROM lineitem)",
      'l_returnflag', ['discount', 'tax', 'l_quantity'])})
SELECT l_returnflag, feature, count(*) FILTER (value IS NULL) AS nulls,
  round(count(*) FILTER (value IS NULL) * 100.0::DOUBLE / count(*), 4) AS null_pct FROM long GROUP BY 1, 2
UNION ALL SELECT l_returnflag, 'TOTAL', count(*) FILTER (value IS NULL),
  round(count(*) FILTER (value IS NULL) * 100.0::DOUBLE / count(*), 4) FROM long GROUP BY 1""",
)
def null_profile_query(spark, folder):
    lines = load(spark, folder, "lineitem").select(
        "l_returnflag",
        F.nullif(F.col("l_discount"), F.lit(0.0)).alias("discount"),
        F.nullif(F.col("l_tax"), F.lit(0.0)).alias("tax"),
        "l_quantity",
    )
    return null_profile(lines, FLAG)


@query(
    "describe",
    f"""WITH {LONG}
SELECT l_returnflag, feature, count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean,
  round(stddev_samp(value), 4) AS std FROM long GROUP BY 1, 2""",
)
def describe_query(spark, folder):
    out = describe(load(spark, folder, "lineitem"), COLS, FLAG)
    return out.withColumns({c: F.round(c, 4) for c in ("mean", "std")})


@query(
    "target_profile",
    """SELECT o_orderstatus, 'o_totalprice' AS feature, count(*) AS n, min(o_totalprice) AS min, max(o_totalprice) AS max,
  round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std,
  round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.5), 4) AS median,
  round(quantile_cont(o_totalprice, 0.75), 4) AS q3 FROM orders GROUP BY 1""",
)
def target_profile_query(spark, folder):
    out = target_profile(load(spark, folder, "orders"), ["o_totalprice"], ["o_orderstatus"])
    digits = {"mean": 3, "std": 3, "q1": 4, "median": 4, "q3": 4}
    return out.withColumns({c: F.round(c, d) for c, d in digits.items()})


@query(
    "moments",
    f"""WITH {LONG},
m AS (SELECT l_returnflag, feature, value - avg(value) OVER (PARTITION BY l_returnflag, feature) AS d FROM long)
SELECT l_returnflag, feature, round(avg(d ** 3) / avg(d ** 2) ** 1.5, 5) + 0.0 AS skewness,
  round(avg(d ** 4) / avg(d ** 2) ** 2 - 3, 5) + 0.0 AS kurtosis FROM m GROUP BY 1, 2""",
)
def moments_query(spark, folder):
    out = moments(load(spark, folder, "lineitem"), COLS, FLAG)
    return out.withColumns({c: r(c, 5) for c in ("skewness", "kurtosis")})


@query(
    "bounds_check",
    f"""WITH {LONG}
SELECT feature, bool_and(value BETWEEN 0.02 AND 100) AS bounded, count(*) FILTER (NOT value BETWEEN 0.02 AND 100) AS outside
FROM long GROUP BY 1""",
)
def bounds_check_query(spark, folder):
    return bounds_check(load(spark, folder, "lineitem"), COLS, 0.02, 100.0)


@query(
    "row_counts",
    """SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'TOTAL' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN grouping(o_orderpriority) = 1 THEN 'TOTAL' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""",
)
def row_counts_query(spark, folder):
    return row_counts(load(spark, folder, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "histogram",
    """WITH ranges AS (SELECT o_orderstatus, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1),
hits AS (SELECT o_orderstatus, least(CAST(floor((o_totalprice - lo) / (hi - lo) * 50) AS BIGINT), 49) AS bin, count(*) AS n
         FROM orders JOIN ranges USING (o_orderstatus) GROUP BY 1, 2)
SELECT ranges.o_orderstatus, 'o_totalprice' AS feature, b AS bin, round(lo + (hi - lo) / 50 * b, 4) AS edge, coalesce(n, 0) AS n
FROM ranges CROSS JOIN range(50) t(b) LEFT JOIN hits h ON h.o_orderstatus = ranges.o_orderstatus AND h.bin = b""",
)
def histogram_query(spark, folder):
    out = histogram(load(spark, folder, "orders"), ["o_totalprice"], 50, ["o_orderstatus"])
    return out.withColumn("edge", F.round("edge", 4))


_QUARTILES = """q AS (SELECT l_returnflag, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
  quantile_cont(value, 0.75) AS q3, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS rows_ FROM long GROUP BY 1, 2)"""


_NULLED = """nulled AS (SELECT nullif(o_orderstatus, 'F') AS status, o_totalprice AS price FROM orders)"""


def _nulled(spark, folder):
    """Orders with a NULL group, and a feature that has no values."""
    status = F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("status")
    return load(spark, folder, "orders").select(status, F.col("o_totalprice").alias("price"), F.lit(None).cast("double").alias("nothing"))


@query(
    "target_profile_nulls",
    f"""WITH {_NULLED}
SELECT status, 'price' AS feature, count(*) AS n, min(price) AS min, max(price) AS max, round(quantile_cont(price, 0.5), 4) AS median FROM nulled GROUP BY 1
UNION ALL SELECT DISTINCT status, 'nothing', 0, NULL, NULL, NULL FROM nulled""",
)
def target_profile_nulls(spark, folder):
    out = target_profile(_nulled(spark, folder), ["price", "nothing"], ["status"])
    return out.select("status", "feature", "n", "min", "max", F.round("median", 4).alias("median"))


@query(
    "histogram_nulls",
    f"""WITH {_NULLED}, ranges AS (SELECT status, min(price) AS lo, max(price) AS hi FROM nulled GROUP BY 1),
hits AS (SELECT n.status, least(CAST(floor((price - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin, count(*) AS n
  FROM nulled n JOIN ranges g ON n.status IS NOT DISTINCT FROM g.status GROUP BY 1, 2)
SELECT ranges.status, 'price' AS feature, b AS bin, coalesce(n, 0) AS n
FROM ranges CROSS JOIN range(20) t(b) LEFT JOIN hits h ON h.status IS NOT DISTINCT FROM ranges.status AND h.bin = b""",
)
def histogram_nulls(spark, folder):
    return histogram(_nulled(spark, folder), ["price", "nothing"], 20, ["status"]).drop("edge")


@query(
    "outliers_nulls",
    f"""WITH {_NULLED}, q AS (SELECT status, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3, avg(price) AS m, stddev_samp(price) AS s FROM nulled GROUP BY 1)
SELECT n.status, 'price' AS feature, count(*) FILTER (price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS iqr_outliers,
  count(*) FILTER (abs((price - m) / s) > 3) AS z_outliers FROM nulled n JOIN q ON n.status IS NOT DISTINCT FROM q.status GROUP BY 1
UNION ALL SELECT DISTINCT status, 'nothing', 0, 0 FROM nulled""",
)
def outliers_nulls(spark, folder):
    return outlier_counts(_nulled(spark, folder), ["price", "nothing"], ["status"]).drop("iqr_pct", "z_pct")


@query(
    "boxplot_nulls",
    f"""WITH {_NULLED} SELECT status, 'price' AS feature, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.75), 4) AS q3 FROM nulled GROUP BY 1
UNION ALL SELECT DISTINCT status, 'nothing', NULL, NULL FROM nulled""",
)
def boxplot_nulls(spark, folder):
    out = boxplot_stats(_nulled(spark, folder), ["price", "nothing"], ["status"])
    return out.select("status", "feature", F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"))


@query(
    "boxplot",
    f"""WITH {LONG}, {_QUARTILES}
SELECT l_returnflag, feature, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  least(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), q1) AS whisker_low,
  greatest(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), q3) AS whisker_high
FROM long JOIN q USING (l_returnflag, feature) GROUP BY l_returnflag, feature, q1, median, q3""",
)
def boxplot(spark, folder):
    out = boxplot_stats(load(spark, folder, "lineitem"), COLS, FLAG)
    return out.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query(
    "outliers",
    """WITH long AS (SELECT event_type, 'value' AS feature, value FROM events),
q AS (SELECT event_type, feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean,
      stddev_samp(value) AS std FROM long GROUP BY 1, 2),
f AS (SELECT event_type, feature, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS i,
      abs((value - mean) / std) > 3 AS z FROM long JOIN q USING (event_type, feature))
SELECT event_type, feature, count(*) FILTER (i) AS iqr_outliers, round(count(*) FILTER (i) * 100.0::DOUBLE / count(*), 4) AS iqr_pct,
  count(*) FILTER (z) AS z_outliers, round(count(*) FILTER (z) * 100.0::DOUBLE / count(*), 4) AS z_pct FROM f GROUP BY 1, 2""",
)
def outliers(spark, folder):
    out = outlier_counts(load(spark, folder, "events"), ["value"], ["event_type"])
    return out.withColumns({c: F.round(c, 4) for c in ("iqr_pct", "z_pct")})


@query(
    "outlier_flags",
    """WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS mean,
  stddev_samp(value) AS std FROM events)
SELECT event_id, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS value_iqr, abs((value - mean) / std) > 3 AS value_z
FROM events, q""",
)
def outlier_flags_query(spark, folder):
    out = outlier_flags(load(spark, folder, "events").select("event_id", "value"), ["value"])
    return out.select("event_id", "value_iqr", "value_z")


_TTEST = """WITH s AS (SELECT 'o_totalprice' AS feature, count(*) FILTER (o_orderstatus = 'F')::DOUBLE AS na,
  count(*) FILTER (o_orderstatus = 'O')::DOUBLE AS nb, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS ma,
  avg(o_totalprice) FILTER (o_orderstatus = 'O') AS mb, var_samp(o_totalprice) FILTER (o_orderstatus = 'F') AS va,
  var_samp(o_totalprice) FILTER (o_orderstatus = 'O') AS vb FROM orders)
SELECT feature, round(ma, 3) AS mean_a, round(mb, 3) AS mean_b, round(abs((mb - ma) / ma) * 100, 5) AS diff_pct,
  round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)), 5) AS t_stat,
  na + nb - 2 AS freedom FROM s"""


def _ttest(spark, folder):
    return ttest_ind(load(spark, folder, "orders"), "o_orderstatus", "F", "O", ["o_totalprice"])


@query("ttest", _TTEST)
def ttest(spark, folder):
    out = _ttest(spark, folder).drop("p_value", "stars")
    return out.withColumns(
        {"mean_a": F.round("mean_a", 3), "mean_b": F.round("mean_b", 3), "diff_pct": F.round("diff_pct", 5), "t_stat": F.round("t_stat", 5)}
    )


@query(
    "ttest_stars",
    f"""SELECT feature, CASE WHEN abs(t_stat) > 3.2905 THEN '***' WHEN abs(t_stat) > 2.5758 THEN '**' WHEN abs(t_stat) > 1.96 THEN '*' ELSE 'ns' END AS stars
FROM ({_TTEST})""",
)
def ttest_stars(spark, folder):
    """With thousands of rows t is as good as normal, so SQL can name the levels."""
    return _ttest(spark, folder).select("feature", "stars")


@query("ttest_p")
def ttest_p(spark, folder):
    return _ttest(spark, folder).select("feature", "p_value", "stars")


@query(
    "source_coverage",
    """SELECT event_type, count(*) AS n, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last,
  round(count(*) / (date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1), 4) AS per_day FROM events GROUP BY 1""",
)
def source_coverage_query(spark, folder):
    out = source_coverage(load(spark, folder, "events"), ["event_type"], "ts")
    return out.withColumns({"first": stamp("first"), "last": stamp("last"), "per_day": F.round("per_day", 4)})


@query(
    "image_sample_report",
    """WITH sized AS (SELECT CASE WHEN length(url) % 7 <> 0 THEN url END AS path, length(html) // 100 AS w, length(url) AS h,
  url LIKE '%/en/%' AS english FROM pages),
sizes AS (SELECT english, CASE WHEN path IS NOT NULL THEN w || 'x' || h END AS size, count(*) AS n, count(path) AS valid
          FROM sized GROUP BY 1, 2)
SELECT english, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(n) - sum(valid) AS BIGINT) AS invalid,
  count(size) AS resolutions, first(size ORDER BY n DESC, size) FILTER (size IS NOT NULL) AS dominant,
  round(sum(valid) * 100.0::DOUBLE / sum(n), 4) AS coverage_pct FROM sizes GROUP BY 1""",
)
def image_sample_report_query(spark, folder):
    sized = load(spark, folder, "pages").select(
        F.when(F.length("url") % 7 != 0, F.col("url")).alias("path"),
        F.floor(F.length("html") / 100).alias("w"),
        F.length("url").alias("h"),
        F.col("url").contains("/en/").alias("english"),
    )
    out = image_sample_report(sized, "path", "w", "h", ["english"])
    return out.withColumn("coverage_pct", F.round("coverage_pct", 4))


# --- scaling ----------------------------------------------------------------

EARLY = "l_shipdate < TIMESTAMP '1999-01-01'"
SCALED = ["l_quantity", "l_extendedprice"]


def _train(lines):
    return lines.where(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))


def _keyed(out):
    return out.select("l_orderkey", "l_linenumber", *[r(f"{c}_scaled", 5).alias(f"{c}_scaled") for c in SCALED])


@query(
    "standard_scale",
    f"""WITH s AS (SELECT avg(l_quantity) AS a1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS a2,
  stddev_pop(l_extendedprice) AS s2 FROM lineitem WHERE {EARLY})
SELECT l_orderkey, l_linenumber, round((l_quantity - a1) / s1, 5) + 0.0 AS l_quantity_scaled,
  round((l_extendedprice - a2) / s2, 5) + 0.0 AS l_extendedprice_scaled FROM lineitem, s""",
)
def standard_scale(spark, folder):
    lines = load(spark, folder, "lineitem")
    return _keyed(apply_scaler(lines, fit_standard(_train(lines), SCALED), SCALED))


@query(
    "standard_scale_by",
    f"""WITH s AS (SELECT l_returnflag, avg(l_quantity) AS a1, stddev_pop(l_quantity) AS s1, avg(l_extendedprice) AS a2,
  stddev_pop(l_extendedprice) AS s2 FROM lineitem WHERE {EARLY} GROUP BY 1)
SELECT l_orderkey, l_linenumber, round((l_quantity - a1) / s1, 5) + 0.0 AS l_quantity_scaled,
  round((l_extendedprice - a2) / s2, 5) + 0.0 AS l_extendedprice_scaled FROM lineitem LEFT JOIN s USING (l_returnflag)""",
)
def standard_scale_by(spark, folder):
    lines = load(spark, folder, "lineitem")
    return _keyed(apply_scaler(lines, fit_standard(_train(lines), SCALED, FLAG), SCALED, FLAG))


@query(
    "robust_scale",
    f"""WITH s AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS a, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS b
  FROM lineitem WHERE {EARLY})
SELECT l_orderkey, l_linenumber, round((l_quantity - a[2]) / (a[3] - a[1]), 5) + 0.0 AS l_quantity_scaled,
  round((l_extendedprice - b[2]) / (b[3] - b[1]), 5) + 0.0 AS l_extendedprice_scaled FROM lineitem, s""",
)
def robust_scale(spark, folder):
    lines = load(spark, folder, "lineitem")
    return _keyed(apply_scaler(lines, fit_robust(_train(lines), SCALED), SCALED))


# --- metrics ----------------------------------------------------------------


def _metrics_sql(by: str) -> str:
    return f"""WITH {PREDICTIONS}
SELECT {by}, count(*) AS n, round(avg((prediction - target) ** 2), 2) AS mse, round(avg(abs(prediction - target)), 4) AS mae,
  round(sqrt(avg((prediction - target) ** 2)), 4) AS rmse,
  round(coalesce(1 - sum((prediction - target) ** 2) / nullif(var_pop(target) * count(*), 0), 0), 6) + 0.0 AS r2,
  round(coalesce(covar_pop(prediction, target) / nullif(sqrt(var_pop(prediction) * var_pop(target)), 0), 0), 6) + 0.0 AS correlation,
  round(avg(prediction - target), 3) AS error_mean, round(stddev_samp(prediction - target), 4) AS error_std,
  min(prediction) AS prediction_min, max(prediction) AS prediction_max, min(target) AS target_min, max(target) AS target_max
FROM pred GROUP BY 1"""


@query("metrics", _metrics_sql("run"))
def metrics(spark, folder):
    out = regression_metrics(predictions(spark, folder), ["run"])
    digits = {"mse": 2, "mae": 4, "rmse": 4, "error_mean": 3, "error_std": 4}
    out = out.withColumns({c: F.round(c, d) for c, d in digits.items()})
    return out.withColumns({c: r(c) for c in ("r2", "correlation")})


@query(
    "batch_metrics",
    f"""WITH {PREDICTIONS},
numbered AS (SELECT *, (row_number() OVER (ORDER BY idx) - 1) // 128 AS batch FROM pred),
per_batch AS (SELECT batch, avg((prediction - target) ** 2) AS mse, avg(abs(prediction - target)) AS mae FROM numbered GROUP BY 1)
SELECT count(*) AS batches, round(avg(mse), 2) AS mse_batch_mean, round(avg(mae), 4) AS mae_batch_mean,
  round(sqrt(avg(mse)), 4) AS rmse_batch_mean FROM per_batch""",
)
def batch_metrics(spark, folder):
    out = batch_mean_metrics(batches(predictions(spark, folder), "idx", 128), "batch_idx")
    return out.withColumns(
        {
            "mse_batch_mean": F.round("mse_batch_mean", 2),
            "mae_batch_mean": F.round("mae_batch_mean", 4),
            "rmse_batch_mean": F.round("rmse_batch_mean", 4),
        }
    )


@query(
    "error_table",
    f"""WITH {PREDICTIONS} SELECT idx, target, prediction, round(prediction - target, 2) + 0.0 AS error,
  round((prediction - target) / greatest(abs(target), 1e-6), 6) + 0.0 AS relative_error FROM pred""",
)
def error_table_query(spark, folder):
    out = error_table(predictions(spark, folder), "idx")
    return out.withColumns({"error": r("error", 2), "relative_error": r("relative_error")})


@query(
    "relative_error",
    f"""WITH {PREDICTIONS} SELECT idx, round((prediction - target) / greatest(abs(target), 1e-6), 6) + 0.0 AS relative_error FROM pred""",
)
def relative_error_query(spark, folder):
    out = error_table(predictions(spark, folder), "idx")
    return out.select("idx", r("relative_error").alias("relative_error"))


@query(
    "best_epoch",
    f"""WITH {HISTORY} SELECT run, first(epoch ORDER BY val_mse, epoch) AS best_epoch, round(min(val_mse), 5) AS best_loss
FROM history GROUP BY 1""",
)
def best_epoch_query(spark, folder):
    return best_epoch(history(spark, folder)).withColumn("best_loss", F.round("best_loss", 5))


# --- validation and verification --------------------------------------------


@query(
    "validate_fear_greed",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'missing_field' WHEN event_type = 'signup' AND value <> floor(value) THEN 'not_integer'
  WHEN floor(value) NOT BETWEEN 0 AND 100 THEN 'out_of_range' END AS violation FROM events""",
)
def validate_fear_greed_query(spark, folder):
    """Signups carry a text that is no number unless whole; errors carry no class."""
    whole = F.floor("value").cast("string")
    decimal = (F.col("event_type") == "signup") & (F.col("value") != F.floor("value"))
    text = F.when(decimal, F.concat(F.lit("~"), F.col("value").cast("string"))).otherwise(whole)
    records = load(spark, folder, "events").select(
        "event_id",
        text.alias("value"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("value_classification"),
        F.col("ts").alias("timestamp"),
    )
    return validate_fear_greed(records).select("event_id", "violation")


_POSTS = """posts AS (SELECT conv_id, turn, '2024-01-' || lpad(CAST(turn + 29 AS VARCHAR), 2, '0') AS timestamp,
  CASE WHEN role <> 'system' THEN text ELSE ' ' END AS combined_text FROM conversations),
judged AS (SELECT conv_id, turn, CASE WHEN trim(combined_text) = '' THEN 'blank_text'
  WHEN TRY_CAST(timestamp AS TIMESTAMP) IS NULL THEN 'bad_timestamp' END AS violation FROM posts)"""


def _posts(spark, folder):
    """Turns from the fourth on fall past the end of the month; system turns are blank."""
    return load(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.concat(F.lit("2024-01-"), F.lpad((F.col("turn") + 29).cast("string"), 2, "0")).alias("timestamp"),
        F.when(F.col("role") != "system", F.col("text")).otherwise(" ").alias("combined_text"),
        F.lit("all").alias("subreddit"),
        F.lit("talk").alias("source"),
    )


@query("validate_posts", f"WITH {_POSTS} SELECT conv_id, turn, violation FROM judged")
def validate_posts_query(spark, folder):
    return validate_posts(_posts(spark, folder)).select("conv_id", "turn", "violation")


@query("violation_counts", f"WITH {_POSTS} SELECT coalesce(violation, 'ok') AS violation, count(*) AS n FROM judged GROUP BY 1")
def violation_counts_query(spark, folder):
    return violation_counts(validate_posts(_posts(spark, folder)))


@query("batch_ok", f"WITH {_POSTS} SELECT count(violation) AS violations, count(violation) = 0 AS batch_ok FROM judged")
def batch_ok_query(spark, folder):
    return batch_ok(validate_posts(_posts(spark, folder)))


@query(
    "validate_news",
    """SELECT d.doc_id, CASE WHEN l.quality IS NULL AND l.toxic IS NULL THEN 'empty_record' END AS violation
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def validate_news_query(spark, folder):
    documents = load(spark, folder, "documents").select("doc_id")
    joined = documents.join(load(spark, folder, "labels"), "doc_id", "left")
    return validate_news(joined, ["quality", "toxic"]).select("doc_id", "violation")


CLAIMS = [("l_quantity", "mean", 25.5), ("l_quantity", "max", 50.0), ("l_discount", "mean", 0.05), ("l_tax", "min", 0.01), ("l_absent", "mean", 1.0)]
_CLAIM_ROWS = ", ".join(f"('{f}', '{s}', {c}::DOUBLE)" for f, s, c in CLAIMS)


@query(
    "claims",
    f"""WITH {LONG}, claims AS (SELECT * FROM (VALUES {_CLAIM_ROWS}) t(feature, stat, claimed)),
stats AS (SELECT feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_samp(value) AS std FROM long GROUP BY 1),
actual AS (SELECT feature, 'min' AS stat, min AS actual FROM stats UNION ALL SELECT feature, 'max', max FROM stats
           UNION ALL SELECT feature, 'mean', mean FROM stats UNION ALL SELECT feature, 'std', std FROM stats)
SELECT feature, stat, round(actual, 4) AS actual, claimed, round(actual - claimed, 4) + 0.0 AS difference,
  coalesce(abs(actual - claimed) < 0.01, false) AS ok FROM actual FULL JOIN claims USING (feature, stat)""",
)
def claims(spark, folder):
    stats = ["min", "max", "mean", "std"]
    wide = describe(load(spark, folder, "lineitem"), COLS)
    actual = melt(wide.withColumnRenamed("feature", "subject"), ["subject"], stats).select(
        F.col("subject").alias("feature"), F.col("feature").alias("stat"), F.col("value").alias("actual")
    )
    claimed = spark.createDataFrame(CLAIMS, "feature string, stat string, claimed double")
    out = compare_to_claims(actual, claimed, ["feature", "stat"])
    return out.withColumns({"actual": F.round("actual", 4), "difference": r("difference", 4)})


VERIFY_CLAIMS = [
    ("rows", "click/train", 490.0, 20.0),
    ("feature", "click/train/volume/max", 10.0, 5.0),
    ("text", "view/train/no_event_pct", 15.1, 5.0),
    ("quartile", "view/test_in_domain/target_score/median", 0.0, 20.0),
    ("rows", "absent/train", 100.0, 1.0),
]
_VERIFY_ROWS = ", ".join(f"('{c}', '{s}', {v}::DOUBLE, {t}::DOUBLE)" for c, s, v, t in VERIFY_CLAIMS)


def _published(spark, folder):
    """The bars as a published table: return, volume, target, text and split."""
    indexed = grid_index(durable(_filled(spark, folder), "filled"), ["asset"], "hour_no")
    scored = durable(target_score(indexed, ["asset"], "row_idx", mode="tanh", pad=False), "scored")
    kept = chronological_split(scored, ["asset"], "row_idx", name="at")
    return published(return_1h(kept, ["asset"], "at", pad=False)).select(
        "asset", "split", "timestamp", "at", "return_1h", "volume", "text_content", "target_score"
    )


_PUBLISHED = f"""{BARS}, {HOURLY},
filled AS (SELECT b.*, coalesce(h.text_content, '{PLACEHOLDER}') AS text_content FROM bars b LEFT JOIN hourly h USING (timestamp)),
moves AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS change, (lead(close, 24) OVER w - close) / nullif(close, 0) AS ahead
          FROM filled WINDOW w AS (PARTITION BY asset ORDER BY timestamp)),
vols AS (SELECT *, stddev_samp(change) OVER (PARTITION BY asset ORDER BY timestamp ROWS BETWEEN 167 PRECEDING AND CURRENT ROW) AS vol FROM moves),
scored AS (SELECT *, tanh(ahead / nullif(1.5 * vol, 0)) * 100 AS target_score FROM vols WHERE ahead IS NOT NULL AND vol IS NOT NULL AND vol <> 0),
numbered AS (SELECT *, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY asset) AS n,
   coalesce((close / nullif(lag(close) OVER w, 0) - 1) * 100, 0) AS return_1h FROM scored WINDOW w AS (PARTITION BY asset ORDER BY timestamp)),
labelled AS (SELECT *, {SPLIT_CASE} AS split FROM numbered),
pub AS (SELECT * FROM labelled WHERE split NOT LIKE 'embargo%')"""


def _null_rows(c: str) -> str:
    return f"SELECT 'nulls', asset || '/' || split || '/{c}', count(*) FILTER ({c} IS NULL)::DOUBLE FROM pub GROUP BY asset, split"


def _feature_rows(c: str) -> str:
    stats = {"min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "std": f"stddev_samp({c})"}
    return " UNION ALL ".join(
        f"SELECT 'feature', asset || '/' || split || '/{c}/{s}', ({e})::DOUBLE FROM pub GROUP BY asset, split" for s, e in stats.items()
    )


def _spread_rows(c: str) -> str:
    at = f"asset || '/' || split || '/{c}/"
    return f"""SELECT 'quartile', {at}' || name, value FROM (
  UNPIVOT (SELECT asset, split, quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS median, quantile_cont({c}, 0.75)::DOUBLE AS q3
    FROM pub GROUP BY asset, split) ON q1, median, q3 INTO NAME name VALUE value)
UNION ALL SELECT 'outliers', {at}' || name, value FROM (
  UNPIVOT (SELECT asset, split, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0::DOUBLE / count(*) AS iqr_pct,
      count(*) FILTER (abs(({c} - m) / s) > 3) * 100.0::DOUBLE / count(*) AS z_pct
    FROM pub JOIN (SELECT asset, split, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, avg({c}) AS m, stddev_samp({c}) AS s
      FROM pub GROUP BY asset, split) USING (asset, split) GROUP BY asset, split) ON iqr_pct, z_pct INTO NAME name VALUE value)"""


def _ttest_rows(c: str) -> str:
    return f"""SELECT 'ttest', '{c}/t_stat', (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1 / na + 1 / nb)) FROM (
SELECT count(*) FILTER (asset = 'click')::DOUBLE AS na, count(*) FILTER (asset = 'view')::DOUBLE AS nb, avg({c}) FILTER (asset = 'click') AS ma,
  avg({c}) FILTER (asset = 'view') AS mb, var_samp({c}) FILTER (asset = 'click') AS va, var_samp({c}) FILTER (asset = 'view') AS vb
  FROM pub WHERE split = 'train')"""


_FEATURES = ["return_1h", "volume", "target_score"]


@query(
    "verify_dataset",
    f"""WITH {_PUBLISHED},
edges AS (SELECT asset, max(epoch(timestamp)) FILTER (split = 'train') AS t1, min(epoch(timestamp)) FILTER (split = 'validation') AS v0,
  max(epoch(timestamp)) FILTER (split = 'validation') AS v1, min(epoch(timestamp)) FILTER (split = 'test_in_domain') AS s0 FROM pub GROUP BY 1),
actual("check", subject, actual) AS (
  SELECT 'rows', asset || '/' || split, count(*)::DOUBLE FROM pub GROUP BY asset, split
  UNION ALL SELECT 'rows', asset || '/TOTAL', count(*)::DOUBLE FROM pub GROUP BY asset
  UNION ALL SELECT 'rows', 'TOTAL/TOTAL', count(*)::DOUBLE FROM pub
  UNION ALL {' UNION ALL '.join(_null_rows(c) for c in ["timestamp", "text_content", *_FEATURES])}
  UNION ALL SELECT 'nulls', asset || '/' || split || '/TOTAL', 0::DOUBLE FROM pub GROUP BY asset, split
  UNION ALL {' UNION ALL '.join(_feature_rows(c) for c in _FEATURES)}
  UNION ALL SELECT 'bounds', asset || '/' || split || '/target_score', count(*) FILTER (NOT target_score BETWEEN -100 AND 100)::DOUBLE FROM pub GROUP BY asset, split
  UNION ALL SELECT 'text', asset || '/' || split || '/' || name, value FROM (
    UNPIVOT (SELECT asset, split, count(*) FILTER (contains(text_content, '[NO_EVENT]')) * 100.0::DOUBLE / count(*) AS no_event_pct,
        min(length(text_content))::DOUBLE AS min_chars, max(length(text_content))::DOUBLE AS max_chars, avg(length(text_content)) AS mean_chars
      FROM pub GROUP BY asset, split) ON no_event_pct, min_chars, max_chars, mean_chars INTO NAME name VALUE value)
  UNION ALL {' UNION ALL '.join(_spread_rows(c) for c in _FEATURES)}
  UNION ALL {' UNION ALL '.join(_ttest_rows(c) for c in _FEATURES)}
  UNION ALL SELECT 'embargo', asset || '/1', (v0 - t1) / 3600 FROM edges
  UNION ALL SELECT 'embargo', asset || '/2', (s0 - v1) / 3600 FROM edges
  UNION ALL SELECT 'gaps', asset, count(*) FILTER (g > 1)::DOUBLE FROM (
    SELECT asset, hour_no - lag(hour_no) OVER (PARTITION BY asset ORDER BY hour_no) AS g FROM pub) GROUP BY asset),
claims AS (SELECT * FROM (VALUES {_VERIFY_ROWS}) t("check", subject, claimed, tolerance))
SELECT "check", subject, round(actual, 4) + 0.0 AS actual, claimed,
  CASE WHEN actual IS NULL AND (claimed IS NOT NULL OR "check" IN ('nulls', 'bounds', 'gaps', 'embargo')) THEN false WHEN "check" IN ('nulls', 'bounds', 'gaps') THEN actual = 0 WHEN "check" = 'embargo' THEN actual >= 24
       WHEN claimed IS NOT NULL THEN abs(actual - claimed) <= tolerance END AS ok
FROM actual FULL JOIN claims USING ("check", subject)""",
)
def verify_dataset_query(spark, folder):
    claimed = spark.createDataFrame(VERIFY_CLAIMS, "check string, subject string, claimed double, tolerance double")
    report = verify_dataset(_published(spark, folder), _FEATURES, claimed, pair=("click", "view"))
    sql_has_none = F.col("subject").endswith("/p_value") | F.col("subject").endswith("/stars")
    return report.where(~sql_has_none).withColumn("actual", r("actual", 4))


@query(
    "training_windows",
    f"""WITH {_PUBLISHED},
s AS (SELECT avg(return_1h::FLOAT::DOUBLE) AS a1, stddev_pop(return_1h::FLOAT::DOUBLE) AS s1, avg(volume) AS a2, stddev_pop(volume) AS s2,
  quantile_cont(target_score::FLOAT::DOUBLE, [0.25, 0.5, 0.75]) AS q FROM pub WHERE split = 'train'),
scaled AS (SELECT asset, idx AS row_idx, ((return_1h::FLOAT::DOUBLE - a1) / s1)::FLOAT::DOUBLE AS x1, ((volume - a2) / s2)::FLOAT::DOUBLE AS x2,
  ((target_score::FLOAT::DOUBLE - q[2]) / (q[3] - q[1]))::FLOAT::DOUBLE AS y,
  row_number() OVER (PARTITION BY asset ORDER BY idx) - 1 AS at_ FROM pub, s WHERE split = 'validation'),
framed AS (SELECT asset, row_idx, at_, y, sum(x1) OVER w AS x1, sum(x2) OVER w AS x2 FROM scaled
  WINDOW w AS (PARTITION BY asset ORDER BY at_ ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT asset, row_idx, at_ - 24 AS idx, round(x1, 3) + 0.0 AS x1, round(x2, 3) + 0.0 AS x2, round(y, 4) + 0.0 AS target FROM framed WHERE at_ >= 24""",
)
def training_windows_query(spark, folder):
    """Validation windows scaled with training statistics; sums stand for the window contents."""
    aligned = durable(_published(spark, folder), "aligned").withColumnRenamed("at", "row_idx")
    features = feature_tables(aligned, tabular=["return_1h", "volume"])
    del features["text"]
    out = training_windows(features, "validation", width=2)
    total = lambda i: F.aggregate("tabular", F.lit(0.0), lambda acc, x: acc + x[i].cast("double"))
    return out.select(
        "asset",
        "row_idx",
        "idx",
        r(total(0), 3).alias("x1"),
        r(total(1), 3).alias("x2"),
        r(F.col("target").cast("double"), 4).alias("target"),
    )


class _TextSizes:
    """An encoder that SQL can follow: characters and words of a text."""

    def __call__(self, texts):
        return np.array([[len(t), t.count(" ") + 1] for t in texts], dtype=np.float32)


@query(
    "training_windows_across",
    f"""WITH {_PUBLISHED},
s AS (SELECT avg(return_1h::FLOAT::DOUBLE) AS a1, stddev_pop(return_1h::FLOAT::DOUBLE) AS s1, avg(volume) AS a2, stddev_pop(volume) AS s2,
  avg(target_score::FLOAT::DOUBLE) AS a3, stddev_pop(target_score::FLOAT::DOUBLE) AS s3 FROM pub WHERE split = 'train'),
scaled AS (SELECT asset, idx AS row_idx, ((return_1h::FLOAT::DOUBLE - a1) / s1)::FLOAT::DOUBLE AS x1, ((volume - a2) / s2)::FLOAT::DOUBLE AS x2,
  ((target_score::FLOAT::DOUBLE - a3) / s3)::FLOAT::DOUBLE AS x3, length(text_content) AS chars, length(text_content) - length(replace(text_content, ' ', '')) + 1 AS words,
  row_number() OVER (ORDER BY asset, idx) - 1 AS at_ FROM pub, s WHERE split = 'test_in_domain'),
framed AS (SELECT asset, row_idx, at_, sum(x1) OVER w AS x1, sum(x2) OVER w AS x2, sum(x3) OVER w AS x3, sum(chars) OVER w AS chars, sum(words) OVER w AS words
  FROM scaled WINDOW w AS (ORDER BY at_ ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT asset, row_idx, at_ - 24 AS idx, round(x1, 3) + 0.0 AS x1, round(x2, 3) + 0.0 AS x2, round(x3, 3) + 0.0 AS x3, chars::BIGINT AS chars, words::BIGINT AS words
FROM framed WHERE at_ >= 24""",
)
def training_windows_across(spark, folder):
    """Test windows over the concatenation of all assets, with text vectors beside the tabular columns."""
    aligned = durable(_published(spark, folder), "aligned").withColumnRenamed("at", "row_idx")
    features = feature_tables(aligned, _TextSizes, ["return_1h", "volume", "target_score"])
    out = training_windows(features, "test_in_domain", width=3, across_assets=True)
    total = lambda c, i: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x[i].cast("double"))
    return out.select(
        "asset",
        "row_idx",
        "idx",
        *[r(total("tabular", i), 3).alias(f"x{i + 1}") for i in range(3)],
        total("text", 0).cast("long").alias("chars"),
        total("text", 1).cast("long").alias("words"),
    )
