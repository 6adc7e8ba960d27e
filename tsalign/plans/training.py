"""From the aligned table to feature tables, and from feature tables to scaled sliding windows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.operators.chunk import CHUNK_ROWS, grid_index, row_index
from tsalign.operators.durable import durable
from tsalign.operators.features import Encoder, HashedTokens, embed_column, embed_with_store
from tsalign.operators.filters import TABULAR, select_feature_vector
from tsalign.operators.joins import zip_modalities
from tsalign.operators.scale import apply_scaler, fit_robust, fit_standard
from tsalign.operators.windows import sequence_windows

KEYS = ["asset", "split", "row_idx"]


def feature_tables(
    aligned: DataFrame,
    encoder: Callable[[], Encoder] = HashedTokens,
    tabular: Sequence[str] = TABULAR,
    images: DataFrame | None = None,
    store: str | None = None,
) -> dict[str, DataFrame]:
    """Raw (unscaled) ``text``, ``tabular`` and ``target`` tables keyed by asset, split and row.

    With ``store`` (see :func:`embed_with_store`) texts that an earlier run met are not encoded again.
    ``images(image_path, vector)`` adds the ``image`` table; a row without a vector keeps a NULL there.
    """
    texts = aligned.select(*KEYS, "text_content")
    if store is None:
        embedded = embed_column(texts, "text_content", "vector", encoder)
    else:
        embedded = embed_with_store(texts, "text_content", store, "vector", encoder)
    out = {
        "text": embedded.select(*KEYS, "vector"),
        "tabular": select_feature_vector(aligned, tabular, "vector").select(*KEYS, "vector"),
        "target": aligned.select(*KEYS, F.col("target_score").cast("float").alias("vector")),
    }
    if images is not None:
        out["image"] = aligned.select(*KEYS, "image_path").join(images, "image_path", "left").select(*KEYS, "vector")
    return out


def training_windows(
    features: Mapping[str, DataFrame],
    split: str,
    width: int = len(TABULAR),
    length: int = 24,
    across_assets: bool = False,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Samples of one split: ``length`` rows of every modality and the target of the row after.

    Tabular columns are standardised and the target is robust-scaled, both with
    the statistics of the training rows. Windows stay inside an asset, or run
    over the concatenation of all assets with ``across_assets``.
    """
    cols = [f"_{i}" for i in range(width)]
    flat = features["tabular"].select(*KEYS, *[F.col("vector")[i].alias(c) for i, c in enumerate(cols)])
    target = features["target"].withColumnRenamed("vector", "_y")
    train = F.col("split") == "train"
    flat = apply_scaler(flat.where(F.col("split") == split), fit_standard(flat.where(train), cols), cols)
    target = apply_scaler(
        target.where(F.col("split") == split), durable(fit_robust(target.where(train), ["_y"]), "scaler"), ["_y"]
    )
    others = [m for m in features if m not in ("tabular", "target")]
    tables = [
        flat.select(*KEYS, F.array(*[F.col(f"{c}_scaled").cast("float") for c in cols]).alias("tabular")),
        target.select(*KEYS, F.col("_y_scaled").cast("float").alias("_target")),
        *[features[m].where(F.col("split") == split).select(*KEYS, F.col("vector").alias(m)) for m in others],
    ]
    glued = durable(zip_modalities(tables, KEYS), "features")
    if across_assets:
        ordered = row_index(glued, [], ["asset", "row_idx"], "_at")
    else:
        ordered = grid_index(glued, ["asset"], "row_idx", "_at", rows=rows)
    by = [] if across_assets else ["asset"]
    return sequence_windows(ordered, by, "_at", ["tabular", *others], "_target", ["asset", "row_idx"], length, rows)
