"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over characters, five at a time, so it holds for every language of
the table and has no unknown words. Counts cover the whole text of every trusted
document but those of the held-out fold; nothing is sampled. Thresholds come from
the median and the interquartile range of the held-out fold's log perplexity, one
for each language; its few outlying texts move neither.

1. Each task counts the distinct 5-grams of its documents (with zero for those of
   untrusted text); the counts meet in a shuffle by 5-gram.
2. Continuation counts, discounts and probabilities of all five orders come from
   shuffled joins between count tables. They give each 5-gram of the corpus its
   interpolated probability, so a document later needs one lookup per character.
3. The 5-grams are cut by hash into shards of at most ``SHARD`` rows (12 bytes
   each), and documents take from every shard the sum over the 5-grams it holds.
   Only one shard at a time goes through the driver.

Defined results: NULL and empty texts, and all texts if nothing is trusted, have
NULL perplexity and are kept; NULL languages are one language; a language
with fewer than ``LEAST`` held-out texts of unlike perplexity takes the threshold
over all languages; copies of a held-out text count once in it; a label that
repeats counts once, and a document with unlike labels or any label toxic is not
trusted; a NULL toxic label says nothing; NULL ids are never trusted; rows that repeat an id are trusted together; a character NUL
counts as U+2400; other columns are ignored or kept unchanged; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured, mix, whole_texts
from tsalign.operators.durable import durable

U64 = np.uint64
ORDER = 5
#: One trusted document in this many is held out for the thresholds.
FOLDS = 5
#: Standard deviations (interquartile range / 1.349) above the held-out median that log perplexity may lie, and a
#: factor on the bound this gives.
SPREADS, TOLERANCE = 4.0, 1.0
#: Held-out texts of unlike perplexity from which a language has a threshold of its own.
LEAST = 20
#: Distinct 5-grams that a task gathers before it hands on their counts.
GATHERED = 4_000_000
#: Rows of a shard, shards between two writes, and characters handled at once.
SHARD, SHARDS_AT_ONCE, BLOCK = 4_000_000, 8, 500_000

_BEGIN, _END, _NUL = 2, 3, 0x2400
_FACTOR = U64(0x9E3779B97F4A7C15)


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """``(text number, code points)``: every piece begins with the ``ORDER - 1`` code points before it."""
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.concatenate([np.full(ORDER - 1, _BEGIN, np.uint32), np.where(codes == 0, _NUL, codes).astype(np.uint32), [np.uint32(_END)]])
        for at in range(0, len(codes) - ORDER + 1, BLOCK):
            yield i, codes[at : at + BLOCK + ORDER - 1]


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(code points, starts of the windows, text number of each window)`` for about ``BLOCK`` characters."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, piece in _pieces(texts):
        if held and size + len(piece) > BLOCK + ORDER:
            yield _joined(held)
            held, size = [], 0
        held.append((i, piece))
        size += len(piece)
    if held:
        yield _joined(held)


def _joined(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for _, p in held])
    begins = np.cumsum(lengths) - lengths
    counts = lengths - ORDER + 1
    owner = np.repeat(np.arange(len(held)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owner]
    return np.concatenate([p for _, p in held]), starts, np.array([i for i, _ in held])[owner]


def _keys(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each window."""
    n = len(codes) - ORDER + 1
    key = np.zeros(n, dtype=U64)
    for j in range(ORDER):
        key *= _FACTOR
        key += codes[j : j + n]
    return mix(key)[starts]


class _Counts:
    """5-grams with trusted counts; distinct ones are merged now and then, and handed on when there are too many."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, grams: np.ndarray) -> None:
        self.parts.append((keys, counts, grams))
        self.size += len(keys)
        if self.size > BLOCK and len(self.parts) > 1:
            self.merge()

    def merge(self) -> None:
        keys, counts, grams = (np.concatenate(x) for x in zip(*self.parts))
        codes, unique = pd.factorize(keys)
        first = np.zeros(len(unique), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.parts = [(unique, np.bincount(codes, counts, len(unique)).astype(np.int64), grams[first])]
        self.size = len(unique)

    def handed_on(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        self.merge()
        keys, counts, grams = self.parts[0]
        for at in range(0, len(keys), 100_000):
            part = np.ascontiguousarray(grams[at : at + 100_000])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[at : at + 100_000].view(np.int64)),
                    pa.array(part.view(f"<U{ORDER}").ravel().tolist(), pa.string()),
                    pa.array(counts[at : at + 100_000]),
                ],
                ["key", "g", "c"],
            )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = _Counts()
    for batch in batches:
        trusted = np.array(batch.column("train").to_pylist(), dtype=bool)
        for codes, starts, owner in _blocks(batch.column("text").to_pylist()):
            slot, unique = pd.factorize(_keys(codes, starts))
            first = np.zeros(len(unique), dtype=np.int64)
            first[slot[::-1]] = starts[::-1]
            counts = np.bincount(slot, trusted[owner], len(unique)).astype(np.int64)
            kept.add(unique, counts, codes[first[:, None] + np.arange(ORDER)])
            if kept.size > GATHERED:
                # the aggregate behind adds them up with what is still to come
                yield from kept.handed_on()
                kept = _Counts()
    yield from kept.handed_on()


def count_grams(texts: DataFrame) -> DataFrame:
    """``key, g, c``: every 5-gram of ``texts`` (``text, train``) with its count in the rows to train on."""
    rows = texts.select("text", F.col("train").cast("boolean").alias("train"))
    return whole_texts(rows).mapInArrow(_count, "key long, g string, c long").groupBy("key", "g").agg(F.sum("c").alias("c"))


def _discounts(levels: list[DataFrame]) -> list[tuple[float, float, float]]:
    """The three discounts of each order from the numbers of n-grams that occur once to four times."""
    rows = [
        t.select(F.lit(k).alias("k"), *[F.count(F.when(F.col("c") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)])
        for k, t in enumerate(levels)
    ]
    out = []
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    for row in sorted(every.collect()):
        n = [max(x, 1) for x in row[1:]]
        y = n[0] / (n[0] + 2 * n[1])
        out.append(tuple(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i) for i in (1, 2, 3)))
    return out


def probabilities(grams: DataFrame) -> DataFrame:
    """``key, logp``: the interpolated probability of every 5-gram of ``grams`` (``key, g, c``), trained on those with counts.

    Each order's table holds all n-grams that end a 5-gram of the corpus, the
    untrained ones with count 0: their probability is the share that discounts
    leave to the lower order, or the lower order's where the context is new.
    """
    levels = [grams]
    for _ in range(ORDER - 1):
        shorter = levels[0].groupBy(F.expr("substring(g, 2)").alias("g")).agg(F.count(F.when(F.col("c") > 0, 1)).alias("c"))
        levels.insert(0, durable(shorter, "continuations"))
    lower = None
    vocabulary = levels[0].where("c > 0").count() + 1
    for k, (level, discounts) in enumerate(zip(levels, _discounts(levels)), 1):
        context = F.expr(f"substring(g, 1, {k - 1})")
        seen = level.where("c > 0").groupBy(context.alias("h"))
        contexts = seen.agg(F.sum("c").alias("total"), *[F.count(F.when(x, 1)).alias(f"n{i}") for i, x in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))])
        rows = level.withColumn("h", context).join(contexts, "h", "left")
        if lower is None:
            rows = rows.withColumn("low", F.lit(1.0 / vocabulary))
        else:
            rows = rows.withColumn("s", F.expr("substring(g, 2)")).join(lower.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
        d1, d2, d3 = (F.lit(d) for d in discounts)
        cut = F.when(F.col("c") > 2, d3).when(F.col("c") == 2, d2).when(F.col("c") == 1, d1).otherwise(0.0)
        left = d1 * F.col("n1") + d2 * F.col("n2") + d3 * F.col("n3")
        p = F.when(F.col("total").isNull(), F.col("low")).otherwise((F.col("c") - cut + left * F.col("low")) / F.col("total"))
        lower = durable(rows.select(*(["key"] if k == ORDER else []), "g", p.alias("p")), "probabilities")
    return lower.select("key", F.log("p").alias("logp"))


def _scorer(shard):
    """Adds to ``total`` what the 5-grams of one shard contribute, and counts the ones found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, logp = shard.value
        for batch in batches:
            n = batch.num_rows
            total = np.array(batch.column("total").to_pylist(), dtype=float)
            found = np.array(batch.column("found").to_pylist(), dtype=np.int64)
            for codes, starts, owner in _blocks(batch.column("text").to_pylist()):
                slot, unique = pd.factorize(_keys(codes, starts))
                at = np.minimum(np.searchsorted(keys, unique), len(keys) - 1)
                hit = keys[at] == unique
                total += np.bincount(owner, np.where(hit, logp[at], 0.0)[slot], n)
                found += np.bincount(owner, hit[slot], n).astype(np.int64)
            columns = {**{name: batch.column(name) for name in batch.schema.names}, "total": pa.array(total), "found": pa.array(found)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def perplexities(texts: DataFrame, scores: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """``texts`` with ``perplexity`` in place of ``text``; ``scores`` as from ``probabilities``."""
    context = texts.sparkSession.sparkContext
    shards = max(1, math.ceil(scores.count() / shard_rows))
    rows = texts.withColumn("total", F.lit(0.0)).withColumn("found", F.lit(0).cast("long"))
    for i in range(shards):
        part = scores.where(F.pmod("key", F.lit(shards)) == i).toArrow()
        keys = part.column("key").to_numpy().view(U64)
        order = np.argsort(keys)
        if len(keys) == 0:
            continue
        shard = context.broadcast((keys[order], part.column("logp").to_numpy()[order]))
        rows = whole_texts(rows).mapInArrow(_scorer(shard), rows.schema)
        if (i + 1) % SHARDS_AT_ONCE == 0 and i + 1 < shards:
            rows = durable(rows, "scored")
    known = (F.col("found") > 0) & (F.col("found") == F.length("text") + 1)
    return rows.select(
        *[c for c in texts.columns if c != "text"], F.when(known, F.exp(-F.col("total") / F.col("found"))).alias("perplexity")
    )


def classify(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    label_id: str = "doc_id",
    label_col: str = "quality",
    toxic_col: str = "toxic",
    spreads: float = SPREADS,
    tolerance: float = TOLERANCE,
    shard_rows: int = SHARD,
) -> DataFrame:
    """Per row: ``doc_id, lang, perplexity, bound, kept``. Trusted documents are those that ``labels`` marks 1 and not toxic."""
    trusted = (
        labels.where(F.col(label_id).isNotNull())
        .groupBy(F.col(label_id).cast("long").alias("known"))
        .agg(F.min(F.coalesce(F.col(label_col), F.lit(0))).alias("least"), F.max(F.coalesce(F.col(toxic_col), F.lit(0))).alias("toxic"))
        .where("least = 1 AND toxic = 0")
        .select("known")
    )
    trusted = measured(trusted, "trusted")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == 0
    rows = rows.join(trusted, F.col("doc_id") == F.col("known"), "left").select(
        "doc_id", "lang", "text", (F.col("known").isNotNull() & ~held).alias("train"), (F.col("known").isNotNull() & held).alias("held")
    )
    grams = durable(count_grams(rows), "grams")
    if grams.where("c > 0").isEmpty():
        scored = rows.select("doc_id", "lang", "held", F.lit(None).cast("double").alias("perplexity"))
    else:
        scored = durable(perplexities(rows.drop("train"), probabilities(grams), shard_rows), "perplexities")
    q = F.percentile_approx(F.log("perplexity"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1_000_000))
    at = F.exp(q[1] + F.lit(spreads / 1.349) * (q[2] - q[0])) * F.lit(tolerance)
    calibration = scored.where("held AND perplexity IS NOT NULL").select("lang", "perplexity").distinct()
    own = calibration.groupBy(F.col("lang").alias("of")).agg(at.alias("own"), F.count("*").alias("n"))
    own = measured(own.where(F.col("n") >= LEAST).select("of", "own"), "bounds")
    overall = calibration.agg(at.alias("overall")).first()[0]
    bound = F.coalesce(F.col("own"), F.lit(overall).cast("double"))
    return scored.join(own, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        "doc_id",
        "lang",
        "perplexity",
        bound.alias("bound"),
        F.coalesce(F.col("perplexity") <= bound, F.lit(True)).alias("kept"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, all columns unchanged.

    Rows that repeat an id go together, when all of them are rejected.
    """
    marked = classify(docs, labels, id_col, text_col, lang_col).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = measured(marked.where("NOT kept").select(F.col("doc_id").alias("gone")), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"))
    return rows.join(gone, F.col("doc") == F.col("gone"), "left_anti").select("row.*")
