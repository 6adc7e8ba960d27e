"""Counts, nulls, distributions, bounds, coverage and group comparisons of a table."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsalign.functions.classes import significance_stars
from tsalign.functions.scalar import is_outlier_iqr, is_outlier_z
from tsalign.operators.chunk import join_keys
from tsalign.operators.durable import durable
from tsalign.operators.quantile import QUARTILES, melt, quantiles, with_fences


def _agg(df: DataFrame, by: Sequence[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _per_feature(df: DataFrame, by: Sequence[str], cols: Sequence[str], stats) -> DataFrame:
    """``stats(col) -> {name: aggregate}`` for every column in one pass, then one row per column."""
    one = _agg(
        df,
        by,
        *[
            F.struct(F.lit(c).alias("feature"), *[a.alias(n) for n, a in stats(c).items()]).alias(f"_f{i}")
            for i, c in enumerate(cols)
        ],
    )
    return one.select(*by, F.inline(F.array(*[F.col(f"_f{i}") for i in range(len(cols))])))


def null_profile(df: DataFrame, by: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """NULL count and percent per column, plus a ``TOTAL`` row; one pass."""
    cols = list(cols) if cols else [c for c in df.columns if c not in by]
    n = F.count(F.lit(1))
    counted = _agg(df, by, n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"_f{i}") for i, c in enumerate(cols)])

    def row(label: str, count: Column, cells: Column) -> Column:
        return F.struct(
            F.lit(label).alias("feature"),
            count.alias("nulls"),
            F.round(F.try_divide(count * 100.0, cells), 4).alias("null_pct"),
        )

    total = sum((F.col(f"_f{i}") for i in range(1, len(cols))), F.col("_f0"))
    rows = [row(c, F.col(f"_f{i}"), F.col("_n")) for i, c in enumerate(cols)]
    return counted.select(*by, F.inline(F.array(*rows, row("TOTAL", total, F.col("_n") * len(cols)))))


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Minimum, maximum, mean and sample deviation per column."""
    return _per_feature(
        df,
        by,
        cols,
        lambda c: {
            "n": F.count(c),
            "min": F.min(F.col(c).cast("double")),
            "max": F.max(F.col(c).cast("double")),
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
        },
    )


def target_profile(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """:func:`describe` with exact quartiles; a feature without values has count 0 and NULLs."""
    keys = [*by, "feature"]
    return join_keys(describe(df, cols, by), quantiles(df, by, cols, QUARTILES), keys, "left")


def moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Population skewness and excess kurtosis; NULL for a constant."""
    return _per_feature(df, by, cols, lambda c: {"skewness": F.skewness(c), "kurtosis": F.kurtosis(c)})


def bounds_check(
    df: DataFrame, cols: Sequence[str], low: float = -100.0, high: float = 100.0, by: Sequence[str] = ()
) -> DataFrame:
    """Whether every value lies in ``[low, high]``."""
    return _per_feature(
        df,
        by,
        cols,
        lambda c: {
            "bounded": F.bool_and(F.col(c).between(low, high)),
            "outside": F.count_if(~F.col(c).between(low, high)),
        },
    )


def row_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per key combination and per prefix of the keys; a rolled-up key reads ``TOTAL``."""
    rolled = df.rollup(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"_g{i}") for i, c in enumerate(by)]
    )
    names = [F.when(F.col(f"_g{i}") == 1, "TOTAL").otherwise(F.col(c).cast("string")).alias(c) for i, c in enumerate(by)]
    return rolled.select(*names, "n")


def split_summary(df: DataFrame, on: str = "timestamp", by: Sequence[str] = ("split",)) -> DataFrame:
    """Rows, first and last stamp, duration in hours and percent of all rows, per split."""
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min(on).alias("first"), F.max(on).alias("last")
    )
    outer = [c for c in by if c != "split"]
    return counted.withColumns(
        {
            "duration_hours": (F.unix_seconds("last") - F.unix_seconds("first")) / 3600.0,
            "share_pct": F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(*outer)),
        }
    )


def embargo_check(df: DataFrame, on: str = "timestamp", by: Sequence[str] = (), hours: float = 24.0) -> DataFrame:
    """Hours between the splits, whether each is long enough, and whether splits overlap."""
    second = F.unix_seconds(on)
    edge = lambda f, split: f(F.when(F.col("split") == split, second))
    edges = _agg(
        df,
        by,
        edge(F.max, "train").alias("_t1"),
        edge(F.min, "validation").alias("_v0"),
        edge(F.max, "validation").alias("_v1"),
        edge(F.min, "test_in_domain").alias("_s0"),
    )
    first, second_gap = (F.col("_v0") - F.col("_t1")) / 3600.0, (F.col("_s0") - F.col("_v1")) / 3600.0
    return edges.select(
        *by,
        first.alias("embargo_1_hours"),
        (first >= hours).alias("embargo_1_ok"),
        second_gap.alias("embargo_2_hours"),
        (second_gap >= hours).alias("embargo_2_ok"),
        ((F.col("_t1") < F.col("_v0")) & (F.col("_v1") < F.col("_s0"))).alias("ordered"),
    )


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 50, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins per group and column with edges, empty bins included; the last bin is closed."""
    keys = [*by, "feature"]
    ranges = durable(
        _per_feature(
            df, by, cols, lambda c: {"low": F.min(F.col(c).cast("double")), "high": F.max(F.col(c).cast("double"))}
        ),
        "ranges",
    )
    place = F.floor(F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * bins)
    hits = (
        join_keys(melt(df, by, cols), ranges, keys)
        .groupBy(*keys, F.coalesce(F.least(place, F.lit(bins - 1)), F.lit(bins // 2)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    grid = ranges.where(F.col("low").isNotNull()).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    width = (F.col("high") - F.col("low")) / bins
    return (
        join_keys(grid.withColumn("bin", F.col("bin").cast("long")), hits, [*keys, "bin"], "left")
        .select(*keys, "bin", (F.col("low") + width * F.col("bin")).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))
    )


def boxplot_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles and whiskers (most extreme values within 1.5 IQR of the box); NULLs for a feature without values."""
    fenced = with_fences(df, by, cols)
    value = F.col("value")
    boxes = (
        fenced.groupBy(*by, "feature", "q1", "median", "q3")
        .agg(
            F.min(F.when(value >= F.col("lower"), value)).alias("_lo"),
            F.max(F.when(value <= F.col("upper"), value)).alias("_hi"),
        )
        .withColumns(
            {"whisker_low": F.least("_lo", "q1"), "whisker_high": F.greatest("_hi", "q3")}
        )
        .drop("_lo", "_hi")
    )
    every = _per_feature(df, by, cols, lambda c: {"_n": F.count(c)}).drop("_n")
    return join_keys(every, boxes, [*by, "feature"], "left")


def outlier_counts(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the 1.5 IQR fences and beyond three sample deviations, with percents of all rows."""
    keys = [*by, "feature"]
    fenced = with_fences(df, by, cols)
    stats = durable(
        _per_feature(
            df,
            by,
            cols,
            lambda c: {"_rows": F.count(F.lit(1)), "_mean": F.avg(c), "_std": F.stddev_samp(c)},
        ),
        "stats",
    )
    value = F.col("value")
    beyond = (value < F.col("lower")) | (value > F.col("upper"))
    far = F.abs(F.try_divide(value - F.col("_mean"), F.col("_std"))) > 3
    counted = join_keys(fenced, stats, keys).groupBy(*keys).agg(F.count_if(beyond).alias("_iqr"), F.count_if(far).alias("_z"))
    every = join_keys(stats, counted, keys, "left")
    counts = {"iqr": F.coalesce("_iqr", F.lit(0)), "z": F.coalesce("_z", F.lit(0))}
    return every.select(
        *keys,
        *[c for k, n in counts.items() for c in (n.alias(f"{k}_outliers"), (n * 100.0 / F.col("_rows")).alias(f"{k}_pct"))],
    )


def outlier_flags(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``{col}_iqr`` and ``{col}_z`` flags on every row, from the table's own statistics."""
    stats = target_profile(df, cols)
    one = durable(
        stats.agg(
            *[
                F.max(F.when(F.col("feature") == c, F.struct("q1", "q3", "mean", "std"))).alias(c)
                for c in cols
            ]
        ).select(F.struct(*cols).alias("s")),
        "flags",
    ).scalar()
    flagged = df.withColumn("_s", one)
    out = {}
    for c in cols:
        s = F.col("_s")[c]
        out[f"{c}_iqr"] = is_outlier_iqr(F.col(c), s["q1"], s["q3"])
        out[f"{c}_z"] = is_outlier_z(F.col(c), s["mean"], s["std"])
    return flagged.withColumns(out).drop("_s")


def _beta_fraction(a: float, b: float, x: float) -> float | None:
    """Continued fraction of the regularised incomplete beta function (modified Lentz).

    Converges in a number of steps that grows with the root of the larger
    parameter; NULL if rounding ever keeps it from settling.
    """
    tiny = 1e-300
    numerator = lambda m: (
        m // 2 * (b - m // 2) * x / ((a + m - 1) * (a + m))
        if m % 2 == 0
        else -(a + m // 2) * (a + b + m // 2) * x / ((a + m - 1) * (a + m))
    )
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value, m, last = d, 2, 100 * (10 + math.isqrt(int(max(a, b))))
    while m < last:
        step = numerator(m)
        d = 1.0 + step * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + step / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return value
        m += 1
    return None


def incomplete_beta(a: float, b: float, x: float) -> float | None:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        part = _beta_fraction(a, b, x)
        return None if part is None else front * part / a
    part = _beta_fraction(b, a, 1.0 - x)
    return None if part is None else 1.0 - front * part / b


#: Degrees of freedom from which Hill's normal expansion (1970) is exact to double precision.
_NEARLY_NORMAL = 10_000.0


def t_p_value(t: float, freedom: float) -> float | None:
    """Two-sided p-value of Student's t."""
    if freedom < _NEARLY_NORMAL:
        return incomplete_beta(freedom / 2.0, 0.5, freedom / (freedom + t * t))
    less = freedom - 0.5
    w = math.sqrt(less * math.log1p(t * t / freedom))
    scale = 48.0 * less * less
    z = w + (w**3 + 3 * w) / scale
    z -= (4 * w**7 + 33 * w**5 + 240 * w**3 + 855 * w) / (10 * scale * (scale + 0.8 * w**4 + 100))
    return math.erfc(z / math.sqrt(2.0))


@F.pandas_udf(T.DoubleType())
def p_values(t: pd.Series, freedom: pd.Series) -> pd.Series:
    """Two-sided p-values; meant for a few rows of test statistics."""
    return pd.Series(
        [t_p_value(a, b) if pd.notna(a) and pd.notna(b) and b > 0 else None for a, b in zip(t, freedom)], dtype="float64"
    )


def ttest_ind(df: DataFrame, group: str, a, b, cols: Sequence[str]) -> DataFrame:
    """Two-sample pooled-variance t-test of ``a`` against ``b`` per column.

    One aggregate over the data; the p-value runs on the resulting few rows.
    """
    one = lambda c, g: F.when(F.col(group) == F.lit(g), F.col(c))
    raw = _per_feature(
        df,
        [],
        cols,
        lambda c: {
            "na": F.count(one(c, a)),
            "nb": F.count(one(c, b)),
            "mean_a": F.avg(one(c, a)),
            "mean_b": F.avg(one(c, b)),
            "va": F.var_samp(one(c, a)),
            "vb": F.var_samp(one(c, b)),
        },
    )
    freedom = (F.col("na") + F.col("nb") - 2).cast("double")
    pooled = F.try_divide((F.col("na") - 1) * F.col("va") + (F.col("nb") - 1) * F.col("vb"), freedom)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("na")) + F.try_divide(F.lit(1.0), F.col("nb"))))
    change = F.abs(F.try_divide(F.col("mean_b") - F.col("mean_a"), F.col("mean_a"))) * 100
    tested = raw.select(
        "feature",
        "mean_a",
        "mean_b",
        F.coalesce(change, F.lit(0.0)).alias("diff_pct"),
        F.try_divide(F.col("mean_a") - F.col("mean_b"), error).alias("t_stat"),
        freedom.alias("freedom"),
    )
    tested = tested.withColumn("p_value", p_values("t_stat", "freedom"))
    return tested.withColumn("stars", significance_stars(F.col("p_value")))


def macro_hourly(df: DataFrame, ts: str, econ: Column, conflict: Column, tone: str) -> DataFrame:
    """Per hour: economy articles, their mean tone, conflict articles."""
    return df.groupBy(F.date_trunc("hour", ts).alias("timestamp")).agg(
        F.count_if(econ).alias("gdelt_econ_volume"),
        F.avg(F.when(econ, F.col(tone))).alias("gdelt_econ_tone"),
        F.count_if(conflict).alias("gdelt_conflict_volume"),
    )


def source_coverage(df: DataFrame, by: Sequence[str], on: str = "timestamp") -> DataFrame:
    """Rows, first and last stamp and mean rows per calendar day, per source."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(on).alias("first"), F.max(on).alias("last"))
    days = F.datediff(F.to_date("last"), F.to_date("first")) + 1
    return out.withColumn("per_day", F.col("n") / days)


def image_sample_report(df: DataFrame, path: str, width: str, height: str, by: Sequence[str] = ()) -> DataFrame:
    """Valid and invalid entries, coverage, number of resolutions and the commonest one."""
    size = F.concat_ws("x", F.col(width).cast("string"), F.col(height).cast("string"))
    valid = F.col(path).isNotNull()
    known = F.when(valid & F.col(width).isNotNull() & F.col(height).isNotNull(), size)
    sizes = df.groupBy(*by, known.alias("_size")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(valid).alias("_valid")
    )
    hits = F.when(F.col("_size").isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col("_size").alias("size")))
    out = _agg(
        sizes,
        by,
        F.sum("_n").alias("rows"),
        F.sum("_valid").alias("valid"),
        (F.sum("_n") - F.sum("_valid")).alias("invalid"),
        F.count("_size").alias("resolutions"),
        F.min(hits)["size"].alias("dominant"),
    )
    return out.withColumn("coverage_pct", F.try_divide(F.col("valid") * 100.0, F.col("rows")))
