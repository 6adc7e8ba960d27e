"""Time stamps and numbers from raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_hour(ts: Column, default_ts: Column | None = None) -> Column:
    """Lower hour; a missing stamp becomes ``default_ts``, else NULL."""
    return F.date_trunc("hour", ts if default_ts is None else F.coalesce(ts, default_ts))


def hour_number(ts: Column | str) -> Column:
    """Whole hours since the epoch: the unit of an hourly series' grid."""
    return F.floor(F.unix_seconds(ts) / 3600)


def parse_iso(c: Column) -> Column:
    """ISO text, naive read as session time (UTC); unparsable text gives NULL."""
    return F.try_to_timestamp(c)


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c.try_cast("long"))


def from_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c.try_cast("double"))


def to_numeric(c: Column) -> Column:
    """Text to double, else NULL. Java's type suffixes (``1d``, ``1f``) are not numbers."""
    number = c.try_cast("double")
    return F.when(~c.rlike(r"[0-9.][dDfF]\s*$") & ~F.isnan(number), number)
