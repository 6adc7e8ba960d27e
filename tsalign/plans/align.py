"""The alignment pipeline: five sources onto one hourly index per asset, labelled and split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.operators.asof import asof_backward
from tsalign.operators.chunk import CHUNK_ROWS, grid_index, row_index
from tsalign.operators.durable import durable
from tsalign.operators.filters import (
    FINAL_COLUMNS,
    PLACEHOLDER,
    fill_missing,
    filter_time_range,
    final_projection,
    image_key,
    require_columns,
)
from tsalign.operators.joins import keep_with_asset_file, left_join_on_time
from tsalign.operators.label import return_1h, target_score
from tsalign.operators.split import label_split
from tsalign.operators.texts import hourly_text
from tsalign.session import use_utc
from tsalign.sources import files


@dataclass(frozen=True)
class Sources:
    """Landed tables; an absent one (None) contributes its documented defaults.

    ``klines`` and ``funding`` carry an ``asset`` column. ``fear_greed``,
    ``macro`` and ``news`` are shared by all assets. ``manifest`` lists
    ``(asset, unix_ts)`` of the charts.
    """

    klines: DataFrame
    funding: DataFrame | None = None
    fear_greed: DataFrame | None = None
    macro: DataFrame | None = None
    news: DataFrame | None = None
    manifest: DataFrame | None = None


def joined_sources(s: Sources) -> DataFrame:
    """Every bar with the funding rate, index and macro news current at its hour."""
    df = require_columns(s.klines, ["asset", "timestamp", "close", "volume"])
    if s.funding is None:
        df = files.with_source_default(df, "funding")
    else:
        df = asof_backward(df, s.funding, "timestamp", ["asset"], ["funding_rate"], _order(s.funding))
    if s.fear_greed is None:
        df = files.with_source_default(df, "fear_greed")
    else:
        values = ["fear_greed_value", "fear_greed_class"]
        df = asof_backward(df, s.fear_greed, "timestamp", [], values, _order(s.fear_greed), clip_by=["asset"])
    return files.with_source_default(df, "macro") if s.macro is None else left_join_on_time(df, s.macro)


def with_text(df: DataFrame, news: DataFrame | None) -> DataFrame:
    """The joined news of each row's hour, or the placeholder."""
    if news is None:
        return files.with_source_default(df, "news")
    text = hourly_text(news, "timestamp", "text_content", _order(news))
    return fill_missing(left_join_on_time(df, text), {"text_content": PLACEHOLDER})


def _order(df: DataFrame) -> list[str]:
    return [c for c in files.FILE_ORDER if c in df.columns]


def align(
    s: Sources,
    start: str,
    end: str,
    horizon: int = 24,
    window: int = 168,
    mode: str = "raw",
    image_folder: str = "charts",
    train: float = 0.70,
    validation: float = 0.15,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The published table with ``asset`` and ``split`` (embargoed rows keep their label).

    Order matters and follows the published data: time range after the joins,
    label on the cut series, charts, and only then the hourly return, so a
    return spans any row dropped before it. Texts drop no row, so they join
    last and never travel through a window.
    """
    by = ["asset"]
    use_utc(s.klines.sparkSession)
    edge = lambda t: F.lit(t).cast("timestamp")
    joined = filter_time_range(joined_sources(s), edge(start), edge(end))
    # A repeated macro stamp repeats the hour; its own columns then settle the order.
    macro = [] if s.macro is None else [c for c in s.macro.columns if c != "timestamp"]
    indexed = row_index(joined, by, ["timestamp", *macro], "_at")
    labelled = target_score(indexed, by, "_at", "close", horizon, window, mode, rows=rows)
    labelled = labelled.withColumns(
        {"unix_ts": F.unix_seconds("timestamp"), "image_path": image_key("asset", "timestamp", image_folder)}
    )
    if s.manifest is not None:
        labelled = keep_with_asset_file(labelled, s.manifest, ["asset", "unix_ts"])
    surviving = grid_index(durable(labelled, "labelled"), by, "_at", "row_idx", total="_total", rows=rows)
    final = return_1h(surviving, by, "row_idx", rows=rows)
    zeros = {c: 0 for c in ("gdelt_econ_volume", "gdelt_econ_tone", "gdelt_conflict_volume")}
    split = label_split(fill_missing(final, zeros), "row_idx", "_total", train, validation, horizon)
    return final_projection(with_text(split, s.news), ["asset", "split", "row_idx", *FINAL_COLUMNS])[0]


def folder_sources(spark: SparkSession, folder: str, assets: list[str], image_folder: str | None = None) -> Sources:
    """Landed files of a folder, by their documented names; absent files become None."""
    use_utc(spark)

    def per_asset(reader, pattern: str) -> DataFrame | None:
        out = None
        for a in assets:
            part = files.read_if_present(reader, spark, f"{folder}/{pattern % a}")
            if part is not None:
                part = part.withColumn("asset", F.lit(a))
                out = part if out is None else out.unionByName(part)
        return out

    # Names of the landed files.
    klines = per_asset(lambda s, p: files.read_klines(s, p, ordered=False), "%sUSDT_klines.csv")
    if klines is None:
        raise FileNotFoundError(f"no bar files under {folder}")
    return Sources(
        klines=klines,
        funding=per_asset(files.read_funding, "%sUSDT_fundingRate.csv"),
        fear_greed=files.read_if_present(files.read_fear_greed, spark, f"{folder}/fear_greed_index.csv"),
        macro=files.read_if_present(files.read_macro, spark, f"{folder}/gdelt_exogenous_data.csv"),
        news=files.read_if_present(files.read_news, spark, f"{folder}/huggingface_crypto_news.csv"),
        manifest=None if image_folder is None else files.read_asset_manifest(spark, image_folder),
    )


def published(aligned: DataFrame) -> DataFrame:
    """The three splits without embargoed rows."""
    return aligned.where(F.col("split").isin("train", "validation", "test_in_domain"))
