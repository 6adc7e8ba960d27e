"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names and texts of the published dataset.
PLACEHOLDER = "[NO_EVENT] market is quiet"
TABULAR = [
    "return_1h",
    "volume",
    "funding_rate",
    "fear_greed_value",
    "gdelt_econ_volume",
    "gdelt_econ_tone",
    "gdelt_conflict_volume",
]
FINAL_COLUMNS = ["timestamp", *TABULAR, "text_content", "image_path", "target_score"]


def filter_time_range(df: DataFrame, start, end, on: str = "timestamp") -> DataFrame:
    """Rows inside ``[start, end]``, both ends included."""
    return df.where(F.col(on).between(F.lit(start), F.lit(end)))


def drop_null_target(df: DataFrame, col: str = "target_score") -> DataFrame:
    return df.na.drop(subset=[col])


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL in any column (or any of ``cols``)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def final_projection(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``cols`` in their order, and the list of those that do not exist."""
    return df.select(*[c for c in cols if c in df.columns]), [c for c in cols if c not in df.columns]


def project_without(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """All columns but the heavy ones; a Parquet scan then never reads those."""
    return df.drop(*cols)


def require_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """NULL → a constant per column, keeping the column's type."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(kinds[c])) for c, v in values.items()})


def image_key(asset: str | Column, ts: str | Column, folder: str) -> Column:
    """``folder/asset/unix-second.png``."""
    asset = F.col(asset) if isinstance(asset, str) else asset
    ts = F.col(ts) if isinstance(ts, str) else ts
    second = F.unix_seconds(ts.cast("timestamp")).cast("string")
    return F.concat(F.lit(folder), F.lit("/"), F.lower(asset), F.lit("/"), second, F.lit(".png"))


def drop_empty_text(df: DataFrame, col: str, text: Column | None = None) -> DataFrame:
    """Rows whose text is not blank; with ``text`` that expression becomes ``col`` first.

    A filter on a computed text would compute it a second time, so the text and
    its test share one generator.
    """
    filled = lambda t: F.length(F.trim(t)) > 0
    if text is None:
        return df.where(filled(F.col(col)))
    return df.select(*[c for c in df.columns if c != col], F.explode(F.filter(F.array(text), filled)).alias(col))


def select_feature_vector(df: DataFrame, cols: Sequence[str], name: str = "tabular") -> DataFrame:
    """The columns as one ``array<float>``, in the order given."""
    return df.withColumn(name, F.array(*[F.col(c).cast("float") for c in cols]))
