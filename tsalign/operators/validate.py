"""Record validation: every row gets its first violation, a batch is good when it has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.functions.time import parse_iso


def _first_violation(*rules: tuple[Column, str]) -> Column:
    out = F.when(rules[0][0], rules[0][1])
    for broken, name in rules[1:]:
        out = out.when(broken, name)
    return out


def _any_null(cols: Sequence[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
    return out


def validate_fear_greed(
    df: DataFrame, value: str = "value", label: str = "value_classification", ts: str = "timestamp"
) -> DataFrame:
    """Required fields, an integer value, inside 0..100."""
    number = F.col(value).try_cast("long")
    return df.withColumn(
        "violation",
        _first_violation(
            (_any_null([value, label, ts]), "missing_field"),
            (number.isNull(), "not_integer"),
            (~number.between(0, 100), "out_of_range"),
        ),
    )


def validate_posts(
    df: DataFrame,
    ts: str = "timestamp",
    text: str = "combined_text",
    required: Sequence[str] = ("subreddit", "source"),
) -> DataFrame:
    """Required fields, non-blank text, an ISO time stamp."""
    return df.withColumn(
        "violation",
        _first_violation(
            (_any_null([ts, text, *required]), "missing_field"),
            (F.trim(F.col(text)) == "", "blank_text"),
            (parse_iso(F.col(ts).cast("string")).isNull(), "bad_timestamp"),
        ),
    )


def validate_news(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A record must hold at least one value."""
    cols = list(cols) if cols else df.columns
    empty = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNull()
    return df.withColumn("violation", _first_violation((empty, "empty_record")))


def violation_counts(df: DataFrame) -> DataFrame:
    """Rows per violation; valid rows are counted under ``ok``."""
    return df.groupBy(F.coalesce("violation", F.lit("ok")).alias("violation")).agg(F.count(F.lit(1)).alias("n"))


def batch_ok(df: DataFrame) -> DataFrame:
    """One row: number of violations and whether the batch passes."""
    return df.agg(F.count("violation").alias("violations"), (F.count("violation") == 0).alias("batch_ok"))
