"""Batch embedding, projection and the tabular baseline."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsalign.functions.subwords import Subwords
from tsalign.operators.durable import durable
from tsalign.sources import committed

Encoder = Callable[[Sequence[str]], np.ndarray]


def xavier_uniform(rows: int, cols: int, seed: int) -> np.ndarray:
    """A seeded ``rows x cols`` matrix, uniform within ``sqrt(6 / (rows + cols))``."""
    bound = math.sqrt(6.0 / (rows + cols))
    return np.random.default_rng(seed).uniform(-bound, bound, size=(rows, cols)).astype(np.float32)


class HashedTokens:
    """Default encoder: signed token hashes in ``width`` buckets, unit length, projected to ``dim``.

    It stands in for a frozen language model, whose weights are not available
    offline. Texts are read whole unless ``max_tokens`` is set.
    """

    def __init__(self, dim: int = 256, width: int = 768, seed: int = 42, max_tokens: int | None = None):
        self.width, self.max_tokens = width, max_tokens
        self.matrix = xavier_uniform(width, dim, seed)

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        tokens = [text.lower().split()[: self.max_tokens] for text in texts]
        lengths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        codes: dict[str, int] = {}
        flat = np.fromiter(
            (codes[t] if t in codes else codes.setdefault(t, zlib.crc32(t.encode())) for line in tokens for t in line),
            dtype=np.int64,
            count=int(lengths.sum()),
        )
        cell = np.repeat(np.arange(len(tokens)), lengths) * self.width + (flat >> 1) % self.width
        bags = np.bincount(cell, weights=1.0 - 2.0 * (flat & 1), minlength=len(tokens) * self.width)
        bags = bags.reshape(len(tokens), self.width)
        norms = np.linalg.norm(bags, axis=1, keepdims=True)
        return (bags / np.where(norms == 0, 1.0, norms)).astype(np.float32) @ self.matrix


def embed_column(
    df: DataFrame,
    col: str,
    name: str = "text_embedding",
    encoder: Callable[[], Encoder] = HashedTokens,
    batch: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """A vector per row of a text column, in Arrow batches.

    ``encoder`` builds the encoder, once per task; it maps a batch of texts to
    a matrix. NULL is read as empty text. Encoding costs far more than moving
    the texts, so ``partitions`` may spread a scan with few splits.
    """
    if partitions is not None:
        df = df.repartition(partitions)

    @F.pandas_udf("array<float>")
    def embed(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in series:
            values = texts.fillna("").tolist()
            rows: list[np.ndarray] = []
            for start in range(0, len(values), batch):
                rows.extend(encode(values[start : start + batch]))
            yield pd.Series(rows, index=texts.index)

    return df.withColumn(name, embed(F.col(col)))


def embed_with_store(
    df: DataFrame,
    col: str,
    store: str,
    name: str = "text_embedding",
    encoder: Callable[[], Encoder] = HashedTokens,
    tokenizer: Callable[[], Subwords] | None = None,
    max_tokens: int | None = None,
    batch: int = 32,
    partitions: int | None = None,
) -> DataFrame:
    """A vector per row of a text column, from a store of vectors keyed by the text's hash.

    Only texts that the committed table at ``store`` lacks are encoded, each
    distinct one once, and added to it; so a run that was killed, or that meets
    rows of an earlier one, goes on from there. One store belongs to one encoder
    and one limit. With ``max_tokens`` the encoder reads the first sub-word tokens
    of a text. Inside a task texts go to the encoder in batches of like length.
    NULL is read as empty text. Texts move only if they are encoded.
    """
    spark = df.sparkSession
    if max_tokens is not None and tokenizer is None:
        raise ValueError("max_tokens counts the tokens of a tokenizer")
    digest = F.sha2(F.coalesce(F.col(col), F.lit("")), 256)
    texts = df.select(digest.alias("digest"), F.coalesce(F.col(col), F.lit("")).alias("text"))
    known = committed.read(spark, store)
    if known is not None:
        texts = texts.join(known.select("digest"), "digest", "left_anti")
    todo = durable(texts.groupBy("digest").agg(F.first("text").alias("text")), "unseen")
    if known is None or not todo.isEmpty():
        if partitions is not None:
            todo = todo.repartition(partitions)

        def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            run, cutter = encoder(), tokenizer() if tokenizer else None
            for frame in frames:
                values = frame["text"].tolist()
                if max_tokens is not None:
                    values = [cutter.head(t, max_tokens) for t in values]
                lengths = cutter.counts(values) if cutter else [len(t) for t in values]
                order = np.argsort(lengths, kind="stable")
                vectors: list = [None] * len(values)
                for start in range(0, len(order), batch):
                    few = order[start : start + batch]
                    for i, vector in zip(few, run([values[i] for i in few])):
                        vectors[i] = vector
                yield pd.DataFrame({"digest": frame["digest"], "vector": vectors})

        committed.commit(todo.mapInPandas(encode, "digest string, vector array<float>"), store, append=True)
    vectors = committed.read(spark, store).select(F.col("digest").alias("_digest"), F.col("vector").alias(name))
    return df.withColumn("_digest", digest).join(vectors, "_digest").drop("_digest")


def project_vectors(
    df: DataFrame, col: str, name: str, in_dim: int = 768, out_dim: int = 256, seed: int = 42
) -> DataFrame:
    """A seeded linear map of a vector column."""

    @F.pandas_udf("array<float>")
    def project(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix = xavier_uniform(in_dim, out_dim, seed)
        for vectors in series:
            if len(vectors) == 0:
                yield pd.Series([], dtype=object)
                continue
            stacked = np.stack(vectors.tolist()).astype(np.float32)
            yield pd.Series(list(stacked @ matrix), index=vectors.index)

    return df.withColumn(name, project(F.col(col)))


def encoder_of(dim: int = 256, seed: int = 42, max_tokens: int | None = None) -> Callable[[], Encoder]:
    return partial(HashedTokens, dim=dim, seed=seed, max_tokens=max_tokens)


def tabular_baseline(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str] | str,
    target: str,
    kind: str = "linear",
    rounds: int = 20,
) -> DataFrame:
    """Fit a regression on ``train`` and add ``prediction`` to ``test``.

    ``features`` are numeric columns or one array column; ``kind`` is
    ``linear`` (closed-form, one pass) or ``trees`` (gradient boosting, ``rounds`` trees).
    Trees read ``train`` once: rows of equal features become one row with their mean
    target, weighted by their number. Under squared error that changes neither the
    gain of a split nor the value of a leaf, and each of the many passes over the
    training rows is over the distinct features. Quantiles for the splits come from
    all rows then, unless more than 10,000 features are distinct.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    vector: Column = F.col(features) if isinstance(features, str) else F.array(*features)
    values = vector.cast("array<double>")
    ready = lambda df: df.withColumn("_x", array_to_vector(values))
    fitted = ready(train)
    if kind == "linear":
        model = LinearRegression(featuresCol="_x", labelCol=target, solver="normal")
    elif kind == "trees":
        # a group with a NULL target keeps NULL, which the fit refuses
        mean = F.when(F.count(target) == F.count(F.lit(1)), F.avg(F.col(target).cast("double")))
        groups = train.groupBy(values.alias("_values")).agg(mean.alias("_y"), F.count(F.lit(1)).cast("double").alias("_n"))
        fitted = durable(groups, "groups").select(array_to_vector("_values").alias("_x"), "_y", "_n")
        model = GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_n", maxIter=rounds, seed=42)
    else:
        raise ValueError(f"unknown kind: {kind}")
    return model.fit(fitted).transform(ready(test)).drop("_x")


def format_prompt(text_chars: int | None = None, name: str = "prompt", **columns: str) -> Column:
    """Instruction text of an aligned row, ending in its score.

    ``columns`` renames the fields read. The news are taken whole, or shortened
    to ``text_chars`` characters (the documented prompt has 500).
    """
    c = lambda field: F.col(columns.get(field, field))
    news = c("text_content") if text_chars is None else F.substring(c("text_content"), 1, text_chars)
    # Wording and number formats of the documented prompt.
    return F.concat(
        F.lit("Analyze cryptocurrency market sentiment.\n\nMarket Data:\n- Price return (1h): "),
        F.format_string("%.2f", c("return_1h")),
        F.lit("%\n- Volume: "),
        F.format_number(c("volume"), 0),
        F.lit("\n- Funding rate: "),
        F.format_string("%.4f", c("funding_rate")),
        F.lit("\n- Fear/Greed: "),
        c("fear_greed_value").cast("string"),
        F.lit("/100\n\nMacro Context:\n- Economy news: "),
        c("gdelt_econ_volume").cast("string"),
        F.lit(" articles (tone: "),
        F.format_string("%.1f", c("gdelt_econ_tone")),
        F.lit(")\n- Conflict news: "),
        c("gdelt_conflict_volume").cast("string"),
        F.lit(" articles\n\nNews:\n"),
        news,
        F.lit("\n\nPredict 24-hour sentiment (-100 to +100).\n\nAnswer: "),
        F.format_string("%.1f", c("target_score")),
    ).alias(name)
