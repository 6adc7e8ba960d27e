"""Chronological split with an embargo, and fixed-size batches."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.functions.scalar import seeded_order
from tsalign.operators.chunk import CHUNK_ROWS, grid_index, row_index

# Split names of the published dataset.
SPLITS = ["train", "validation", "test_in_domain"]


def split_bounds(n: Column, train: float, validation: float, embargo: int) -> tuple[Column, Column, Column, Column]:
    """End of train, of the first embargo, of validation and of the second embargo.

    The cut is truncated in double: 0.7 * 90 gives 62, not 63.
    """
    end_train = F.floor(F.lit(float(train)) * n)
    end_gap = end_train + embargo
    end_validation = end_gap + F.floor(F.lit(float(validation)) * n)
    return end_train, end_gap, end_validation, end_validation + embargo


def label_split(
    df: DataFrame, pos: str, total: str, train: float = 0.70, validation: float = 0.15, embargo: int = 24
) -> DataFrame:
    """Add ``split`` from a row's position and its series' length."""
    a, b, c, d = split_bounds(F.col(total), train, validation, embargo)
    at = F.col(pos)
    return df.withColumn(
        "split",
        F.when(at.isNull(), None)
        .when(at < a, SPLITS[0])
        .when(at < b, "embargo_1")
        .when(at < c, SPLITS[1])
        .when(at < d, "embargo_2")
        .otherwise(SPLITS[2]),
    )


def chronological_split(
    df: DataFrame,
    by: Sequence[str],
    pos: str,
    train: float = 0.70,
    validation: float = 0.15,
    embargo: int = 24,
    name: str = "row_idx",
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Split by position per series: train, embargo, validation, embargo, test.

    ``pos`` is an integer unique per series (an hour number or an earlier
    index); the position is recounted, so filtered frames are fine.
    """
    indexed = grid_index(df, by, pos, name, total="_total", rows=rows)
    return label_split(indexed, name, "_total", train, validation, embargo).drop("_total")


def embargo_audit(
    df: DataFrame, pos: str, total: str, every: int = 6, train: float = 0.70, validation: float = 0.15, embargo: int = 24
) -> DataFrame:
    """Every ``every``-th embargoed row with its 1-based number inside the embargo."""
    a, _, c, _ = split_bounds(F.col(total), train, validation, embargo)
    labelled = label_split(df, pos, total, train, validation, embargo)
    within = F.col(pos) - F.when(F.col("split") == "embargo_1", a).otherwise(c)
    return (
        labelled.where(F.col("split").isin("embargo_1", "embargo_2"))
        .withColumn("hour_number", within + 1)
        .where((F.col("hour_number") - 1) % every == 0)
    )


def batches(
    df: DataFrame,
    pos: str,
    size: int,
    drop_last: bool = False,
    seed: int | None = None,
) -> DataFrame:
    """Add ``batch_idx``; in ``pos`` order, or in a repeatable shuffled order with a ``seed``.

    ``pos`` is unique; ids may be as sparse as they like. The shuffled order sorts by a seeded hash, so
    it is the same on every run and needs no random state.
    """
    if seed is None:
        indexed = row_index(df, [], [pos], "_at", total="_total")
    else:
        keyed = df.withColumn("_key", seeded_order(F.col(pos), seed))
        indexed = row_index(keyed, [], ["_key", pos], "_at", total="_total").drop("_key")
    out = indexed.withColumn("batch_idx", F.floor(F.col("_at") / F.lit(size)))
    if drop_last:
        out = out.where(F.col("batch_idx") < F.floor(F.col("_total") / F.lit(size)))
    return out.drop("_at", "_total")


#: Rounds of the keyed permutation, and the prime that its round function works in.
ROUNDS, _PRIME = 24, 2**31 - 1


def round_keys(seed: int, epoch: int = 0) -> list[tuple[int, int, int, int]]:
    """The keys of one epoch's permutation."""
    rng = random.Random(f"{seed}:{epoch}")
    return [tuple(rng.randrange(1, _PRIME) for _ in range(4)) for _ in range(ROUNDS)]


def permuted(pos: Column, n: Column, seed: int, epoch: int = 0) -> Column:
    """The place of ``pos`` in a keyed permutation of ``0 .. n - 1``, as an expression.

    In every round a position and its mirror image about the round's key change
    places or not, as a hash of the greater of both decides. That is a bijection
    for any ``n``, without walking cycles, and needs no other row.
    """
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip("kabc", key)]) for key in round_keys(seed, epoch)])

    def step(x: Column, key: Column) -> Column:
        mirror = (key["k"] % n + n - x) % n
        z = (F.greatest(x, mirror) % _PRIME * key["a"] + key["b"]) % _PRIME
        z = (z * z + key["c"]) % _PRIME
        return F.when(F.shiftright(z, 16) % 2 == 1, mirror).otherwise(x)

    return F.aggregate(keys, pos.cast("long"), step)


def epoch_batches(
    df: DataFrame, pos: str, total: str | Column, size: int, epoch: int = 0, seed: int = 42, drop_last: bool = True
) -> DataFrame:
    """Add ``batch_idx`` and ``in_batch`` of one epoch: each epoch has its own order, and no row moves.

    ``pos`` is a dense 0-based index of ``total`` rows (see ``row_index`` and
    ``grid_index``), made once for all epochs. A row without a position has no batch.
    """
    n = (F.col(total) if isinstance(total, str) else total).cast("long")
    place = permuted(F.col(pos), n, seed, epoch)
    out = df.withColumn("_place", place).withColumns({"batch_idx": F.floor(F.col("_place") / size), "in_batch": (F.col("_place") % size).cast("int")})
    if drop_last:
        out = out.where(F.col("batch_idx").isNull() | (F.col("batch_idx") < F.floor(n / size)))
    return out.drop("_place")
