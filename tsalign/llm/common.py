"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.operators.durable import durable

#: Rows up to which a table counts as small enough to be sent to every executor.
BROADCAST_ROWS = 1_000_000


#: Rows of an Arrow batch of whole texts; Spark's default of 10,000 holds too many of them in memory.
BATCH_ROWS = 1000

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def whole_texts(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches made small enough for rows that are whole texts."""
    session = df.sparkSession.conf
    if not 0 < int(session.get(_BATCH)) <= BATCH_ROWS:
        session.set(_BATCH, str(BATCH_ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(df: DataFrame, label: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` written once, with a broadcast hint if it holds at most ``rows`` rows.

    Meant for narrow rows of known width. Above the limit the plain scan comes
    back and Spark shuffles the join.
    """
    kept = durable(df, label)
    return F.broadcast(kept) if kept.count() <= rows else kept


def same(left, right):
    """Equality that also matches NULL with NULL."""
    return left.eqNullSafe(right)


_U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    x = x.astype(_U64, copy=True)
    x ^= x >> _U64(30)
    x *= _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x
