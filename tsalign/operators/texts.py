"""Hourly text, coverage, lengths and source mixing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separator and placeholder mark of the published dataset.
SEPARATOR = " [SEP] "
NO_EVENT = "[NO_EVENT]"

_RUN = 4_096


def grouped_text(
    df: DataFrame, keys: Sequence[str], text: str, order: Sequence[str], name: str = "text_content"
) -> DataFrame:
    """Non-NULL texts of a key joined with the separator, in ``order``; ``''`` when all are NULL.

    Two levels: runs of at most 4,096 consecutive sequence numbers are joined
    first, then the runs, so no task ever sorts the single texts of a busy key.
    ``order`` ends in an integer sequence, earlier columns are its prefix (file
    and block for rows read from files).
    """
    *prefix, seq = order
    run = F.floor(F.col(seq) / _RUN)
    known = F.when(F.col(text).isNotNull(), F.struct(F.col(seq).alias("seq"), F.col(text).alias("text")))
    runs = df.groupBy(*keys, *prefix, run.alias("_run")).agg(F.array_sort(F.collect_list(known)).alias("_items"))
    joined = F.array_join(F.transform("_items", lambda x: x["text"]), SEPARATOR)
    runs = runs.select(
        *keys,
        F.when(
            F.size("_items") > 0,
            F.struct(*[F.col(p) for p in prefix], F.col("_run"), joined.alias("text")),
        ).alias("_piece"),
    )
    pieces = F.transform(F.array_sort(F.collect_list("_piece")), lambda x: x["text"])
    return runs.groupBy(*keys).agg(F.array_join(pieces, SEPARATOR).alias(name))


def hourly_text(
    df: DataFrame, ts: str, text: str, order: Sequence[str], name: str = "text_content", on: str = "timestamp"
) -> DataFrame:
    """Texts of each hour in file order."""
    return grouped_text(df.withColumn("_hour", F.date_trunc("hour", ts)), ["_hour"], text, order, name).withColumnRenamed(
        "_hour", on
    )


def is_placeholder(text: Column, regex_compat: bool = False) -> Column:
    """Literal search for the mark; ``regex_compat`` reads it as a character class instead."""
    return text.rlike(r"[NO_EVENT]") if regex_compat else text.contains(NO_EVENT)


def text_coverage(df: DataFrame, text: str, by: Sequence[str] = (), regex_compat: bool = False) -> DataFrame:
    """Rows, placeholder rows, and their shares in percent."""
    quiet = F.coalesce(is_placeholder(F.col(text), regex_compat), F.lit(False))
    n = F.count(F.lit(1))
    aggs = [
        n.alias("n"),
        F.count_if(quiet).alias("no_event"),
        F.count_if(~quiet).alias("real"),
        F.try_divide(F.count_if(quiet) * 100.0, n).alias("no_event_pct"),
        F.try_divide(F.count_if(~quiet) * 100.0, n).alias("real_pct"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def text_length_stats(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    size = F.length(text)
    aggs = [F.min(size).alias("min_chars"), F.max(size).alias("max_chars"), F.avg(size).alias("mean_chars")]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def asset_mention_share(df: DataFrame, assets: str, names: Sequence[str]) -> DataFrame:
    """Percent of rows that mention each asset; ``assets`` is the comma-separated list."""
    listed = F.split(assets, ",")
    n = F.count(F.lit(1))
    one = df.agg(
        *[F.try_divide(F.count_if(F.array_contains(listed, a)) * 100.0, n).alias(f"_{i}") for i, a in enumerate(names)]
    )
    rows = F.array(*[F.struct(F.lit(a).alias("asset"), F.col(f"_{i}").alias("share_pct")) for i, a in enumerate(names)])
    return one.select(F.inline(rows))


def combine_text_sources(parts: dict[str, DataFrame]) -> DataFrame:
    """Several text tables in one schema with a ``source`` tag; columns one side lacks are NULL."""
    out = None
    for name, part in parts.items():
        tagged = part.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
