"""Sort, head, sample, keep-first deduplication and concatenation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.functions.scalar import seeded_order
from tsalign.functions.text import text_hash

# Names tried in turn as the record key.
RECORD_KEYS = ["id", "url", "title", "news_id"]


def sort_by_time(df: DataFrame, on: str = "timestamp", *ties: str) -> DataFrame:
    return df.orderBy(on, *ties)


def head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows by position."""
    return df.orderBy(*order).limit(n)


def random_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows that are the same on every run: the smallest seeded hashes of a unique key."""
    return df.orderBy(seeded_order(F.col(key), seed), key).limit(n)


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``.

    An aggregate, not a window: copies collapse inside each map task, so a key
    holding a third of all rows shuffles one row per task.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("_row.*")


def first_existing(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((c for c in names if c in df.columns), None)


def dedupe_on_first_key(
    df: DataFrame, order: Sequence[str], names: Sequence[str] = RECORD_KEYS
) -> DataFrame:
    """Keep-first on the first of ``names`` that is a column; unchanged when none is."""
    key = first_existing(df, names)
    return dedupe_keep_first(df, [key], order) if key else df


def removed_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows keep-first would remove."""
    return df.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra")).agg(
        F.coalesce(F.sum("_extra"), F.lit(0)).alias("removed")
    )


def dedupe_by_text_hash(df: DataFrame, text: str, order: Sequence[str]) -> DataFrame:
    """Keep the first of texts that are equal up to case; ``order`` ends in a unique column.

    Hashes and order columns alone pick the winners; the other columns meet them
    in a semi-join and are pruned where nobody asks for them.
    """
    hashed = df.withColumn("text_hash", text_hash(F.col(text)))
    place = F.struct(*order)
    winners = hashed.groupBy("text_hash").agg(F.min(place).alias("_place")).select(F.struct("text_hash", "_place").alias("_won"))
    return hashed.withColumn("_won", F.struct("text_hash", place.alias("_place"))).join(winners, "_won", "left_semi").drop("_won")


def concat_assets(parts: dict[str, DataFrame]) -> DataFrame:
    """Per-asset tables under one another, with the asset and its ordinal."""
    out = None
    for i, (asset, part) in enumerate(parts.items()):
        tagged = part.withColumns({"asset": F.lit(asset), "ordinal": F.lit(i)})
        out = tagged if out is None else out.unionByName(tagged)
    return out


def concat_splits(parts: Sequence[DataFrame], *order: str) -> DataFrame:
    """Splits under one another, sorted again."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy(*order)
