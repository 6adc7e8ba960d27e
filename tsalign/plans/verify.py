"""The acceptance report of a published dataset: ten checks per asset and split in one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsalign.functions.time import hour_number
from tsalign.operators.chunk import CHUNK_ROWS, chunk_of, earlier, join_keys
from tsalign.operators.durable import durable
from tsalign.operators.profile import p_values
from tsalign.operators.quantile import with_fences
from tsalign.operators.texts import is_placeholder


def _path(*parts: str | Column) -> Column:
    named = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts]
    return F.concat_ws("/", *named)


def _line(check: str, subject: Column, actual: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), subject.alias("subject"), actual.cast("double").alias("actual"))


def _lines(df: DataFrame, lines: Sequence[Column]) -> DataFrame:
    """One pass over a small table, a row for each line."""
    return df.select(F.inline(F.array(*lines)))


def _stat(name: str, col: str) -> str:
    return f"{name}:{col}"


def _grain(df: DataFrame, features: Sequence[str], target: str, text: str, image: str | None) -> DataFrame:
    """Every count, moment and edge per asset and split, in one aggregate over the data."""
    value = lambda c: F.col(c).cast("double")
    checked = [c for c in df.columns if c not in ("asset", "split", "_hour")]
    aggs = [F.count(F.lit(1)).alias("n"), F.min(F.unix_seconds("timestamp")).alias("first"), F.max(F.unix_seconds("timestamp")).alias("last")]
    aggs += [F.count_if(F.col(c).isNull()).alias(_stat("nulls", c)) for c in checked]
    for c in features:
        aggs += [F.count(c).alias(_stat("count", c)), F.min(value(c)).alias(_stat("min", c)), F.max(value(c)).alias(_stat("max", c))]
        aggs += [F.avg(c).alias(_stat("mean", c)), F.stddev_samp(c).alias(_stat("std", c))]
    aggs.append(F.count_if(~F.col(target).between(-100.0, 100.0)).alias("outside"))
    aggs.append(F.count_if(F.coalesce(is_placeholder(F.col(text)), F.lit(False))).alias("quiet"))
    size = F.length(text)
    aggs += [F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.avg(size).alias("mean_chars")]
    if image:
        aggs.append(F.count(image).alias("images"))
    return durable(df.groupBy("asset", "split").agg(*aggs), "grain")


def _grain_lines(grain: DataFrame, columns: Sequence[str], features: Sequence[str], target: str, image: str | None) -> DataFrame:
    at = (F.col("asset"), F.col("split"))
    nulls = {c: F.col(f"`{_stat('nulls', c)}`") for c in columns}
    every = F.lit(0)
    for n in nulls.values():
        every = every + n
    lines = [_line("rows", _path(*at), F.col("n"))]
    lines += [_line("nulls", _path(*at, c), n) for c, n in nulls.items()]
    lines.append(_line("nulls", _path(*at, "TOTAL"), every))
    lines += [_line("feature", _path(*at, c, s), F.col(f"`{_stat(s, c)}`")) for c in features for s in ("min", "max", "mean", "std")]
    lines.append(_line("bounds", _path(*at, target), F.col("outside")))
    lines.append(_line("text", _path(*at, "no_event_pct"), F.col("quiet") * 100.0 / F.col("n")))
    lines += [_line("text", _path(*at, c), F.col(c)) for c in ("min_chars", "max_chars", "mean_chars")]
    if image:
        lines.append(_line("images", _path(*at, "coverage_pct"), F.col("images") * 100.0 / F.col("n")))
    return _lines(grain, lines)


def _totals(grain: DataFrame) -> DataFrame:
    """Row counts over the splits of an asset and over all."""
    per_asset = grain.groupBy("asset").agg(F.sum("n").alias("n"))
    return _lines(per_asset, [_line("rows", _path(F.col("asset"), "TOTAL"), F.col("n"))]).unionByName(
        _lines(grain.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), [_line("rows", F.lit("TOTAL/TOTAL"), F.col("n"))])
    )


def _embargo(grain: DataFrame) -> DataFrame:
    edge = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    edges = grain.groupBy("asset").agg(
        ((edge("validation", "first") - edge("train", "last")) / 3600.0).alias("1"),
        ((edge("test_in_domain", "first") - edge("validation", "last")) / 3600.0).alias("2"),
    )
    return _lines(edges, [_line("embargo", _path(F.col("asset"), i), F.col(i)) for i in ("1", "2")])


def _tests(grain: DataFrame, features: Sequence[str], pair: tuple[str, str]) -> DataFrame:
    """Pooled two-sample t-tests of the training rows of two assets, from their counts, means and deviations."""
    train = grain.where(F.col("split") == "train")
    of = lambda asset, name, c: F.max(F.when(F.col("asset") == asset, F.col(f"`{_stat(name, c)}`"))).cast("double")
    one = train.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                *[of(a, s, c).alias(f"{s}_{k}") for k, a in enumerate(pair) for s in ("count", "mean", "std")],
            ).alias(f"f{i}")
            for i, c in enumerate(features)
        ]
    )
    rows = one.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(features))])))
    freedom = F.col("count_0") + F.col("count_1") - 2
    within = lambda k: (F.col(f"count_{k}") - 1) * F.col(f"std_{k}") * F.col(f"std_{k}")
    pooled = F.try_divide(within(0) + within(1), freedom)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), F.col("count_0")) + F.try_divide(F.lit(1.0), F.col("count_1"))))
    tested = rows.select("feature", F.try_divide(F.col("mean_0") - F.col("mean_1"), error).alias("t"), freedom.alias("freedom"))
    tested = tested.withColumn("p", p_values("t", "freedom"))
    p = F.col("p")
    stars = F.when(p < 0.001, 3).when(p < 0.01, 2).when(p < 0.05, 1).when(p.isNotNull(), 0)
    named = {"t_stat": F.col("t"), "p_value": p, "stars": stars}
    return _lines(tested, [_line("ttest", _path(F.col("feature"), s), v) for s, v in named.items()])


def _spread(df: DataFrame, grain: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quartiles and outlier shares per asset, split and feature."""
    keys = ["asset", "split", "feature"]
    moments = grain.select(
        "asset",
        "split",
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(f"`{_stat('mean', c)}`").alias("mean"), F.col(f"`{_stat('std', c)}`").alias("std"))
                    for c in features
                ]
            )
        ),
    )
    fenced = with_fences(df, ["asset", "split"], features)
    value = F.col("value")
    beyond = (value < F.col("lower")) | (value > F.col("upper"))
    far = F.abs(F.try_divide(value - F.col("mean"), F.col("std"))) > 3
    rows = (
        join_keys(fenced, moments, keys)
        .groupBy(*keys, "q1", "median", "q3", "n")
        .agg(F.count_if(beyond).alias("iqr"), F.count_if(far).alias("z"))
    )
    at = (F.col("asset"), F.col("split"), F.col("feature"))
    lines = [_line("quartile", _path(*at, q), F.col(q)) for q in ("q1", "median", "q3")]
    lines += [_line("outliers", _path(*at, f"{s}_pct"), F.col(s) * 100.0 / F.col("n")) for s in ("iqr", "z")]
    return _lines(rows, lines)


def _gaps(df: DataFrame, rows: int) -> DataFrame:
    """Distances of more than an hour between neighbours of an asset, chunk by chunk and over the chunks' borders."""
    chunked = df.where(F.col("_hour").isNotNull()).select("asset", "_hour", chunk_of("_hour", rows).alias("_chunk"))
    step = F.col("_hour") - F.lag("_hour").over(Window.partitionBy("asset", "_chunk").orderBy("_hour"))
    inside = chunked.withColumn("wide", step > 1).groupBy("asset", "_chunk").agg(
        F.count_if("wide").alias("wide"), F.min("_hour").alias("low"), F.max("_hour").alias("high")
    )
    border = F.col("low") - F.max("high").over(earlier(["asset"], "_chunk"))
    counted = inside.withColumn("wide", F.col("wide") + F.when(border > 1, 1).otherwise(0)).groupBy("asset").agg(F.sum("wide").alias("n"))
    return _lines(counted, [_line("gaps", _path(F.col("asset")), F.col("n"))])


def verify_dataset(
    df: DataFrame,
    features: Sequence[str],
    claims: DataFrame,
    pair: tuple[str, str],
    target: str = "target_score",
    text: str = "text_content",
    image: str | None = None,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows ``(check, subject, actual, claimed, ok)``; subjects are paths that begin with asset and split.

    ``df`` holds ``asset``, ``split``, ``timestamp``, the features, the text and
    the target (and an image path, whose coverage is then checked).
    ``claims(check, subject, claimed, tolerance)`` are compared where given, and
    a claim about something absent is not ok; nulls, bounds, gaps and embargo
    carry their own rule. The table is written once: one aggregate gives all
    counts and moments, bracketed quantiles the quartiles and outliers, and the
    gaps come from chunks of hours.
    """
    measured = list(dict.fromkeys([*features, target]))
    columns = ["timestamp", text, *measured, *([image] if image else [])]
    df = durable(df.select("asset", "split", *columns, hour_number("timestamp").alias("_hour")), "published")
    grain = _grain(df, measured, target, text, image)
    report = _grain_lines(grain, columns, measured, target, image)
    for part in (_totals(grain), _embargo(grain), _tests(grain, measured, pair), _spread(df, grain, measured), _gaps(df, rows)):
        report = report.unionByName(part)
    ok = (
        F.when(F.col("check").isin("nulls", "bounds", "gaps"), F.col("actual") == 0)
        .when(F.col("check") == "embargo", F.col("actual") >= 24)
        .when(F.col("claimed").isNotNull(), F.abs(F.col("actual") - F.col("claimed")) <= F.col("tolerance"))
    )
    judged = F.col("claimed").isNotNull() | F.col("check").isin("nulls", "bounds", "gaps", "embargo")
    ok = F.when(judged, F.coalesce(ok, F.lit(False))).otherwise(ok)
    return report.join(claims, ["check", "subject"], "full_outer").withColumn("ok", ok).drop("tolerance")
