"""Categorical readings of indices, ratios, tones and p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _bands(c: Column, uppers: list[tuple[float, str]], last: str) -> Column:
    """First band whose exclusive upper bound lies above the value, else ``last``; NULL stays NULL."""
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for upper, label in uppers:
        out = out.when(c < upper, label)
    return out.otherwise(last)


def sentiment_class(score: Column) -> Column:
    # Thresholds of the three classes.
    return (
        F.when(score.isNull(), F.lit(None).cast("string"))
        .when(score <= -20, "Bearish")
        .when(score >= 20, "Bullish")
        .otherwise("Neutral")
    )


def fear_greed_class(value: Column) -> Column:
    # Index levels.
    return _bands(value, [(25, "Extreme Fear"), (46, "Fear"), (54, "Neutral"), (75, "Greed")], "Extreme Greed")


def ratio_class(ratio: Column) -> Column:
    # Readings of the long/short ratio.
    return (
        F.when(ratio.isNull(), F.lit(None).cast("string"))
        .when(ratio > 3.0, "Extremely bullish")
        .when(ratio >= 1.5, "Moderately bullish")
        .when(ratio >= 1.0, "Neutral to slightly bullish")
        .otherwise("Bearish")
    )


def tone_class(tone: Column) -> Column:
    # Tone scale.
    return _bands(
        tone, [(-50, "Very negative"), (-10, "Negative"), (10, "Neutral"), (50, "Positive")], "Very positive"
    )


def significance_stars(p: Column) -> Column:
    # Significance levels.
    return (
        F.when(p.isNull(), F.lit(None).cast("string"))
        .when(p < 0.001, "***")
        .when(p < 0.01, "**")
        .when(p < 0.05, "*")
        .otherwise("ns")
    )
