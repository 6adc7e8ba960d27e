"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to its cell's centre, scaled to length one, rotated
by a seeded random rotation and reduced to the signs of its components, packed
eight to a byte, with two scalars: its distance from the centre and the inner
product of the unit vector with its own code. From a code, the inner product
with a rotated query is estimated without bias, and the error is bounded with a
probability set by ``CONFIDENCE``. Only vectors whose lower bound does not exceed
the query's tenth best distance so far are compared exactly, on the original
vectors in double precision.

The centres are fitted on a bounded sample (``SAMPLE`` rows with the smallest id
hashes); every vector is indexed, once. Index blocks are made where the rows are
read, without a shuffle; queries travel to them in blocks, a bounded set of blocks
at a time, and skip a block whose cell is farther than what they already found. Each task returns at most ``k`` rows per query, so no query's candidates
ever meet in one place.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite
components take no part, nor do those of another length than the most frequent
one (the smaller at a tie); ties in distance go to the smaller id; a query whose
id repeats uses its smallest vector and never finds rows of its own id; other
repeated rows are candidates each; NULL ids take no part; with fewer than ``k``
candidates all are returned; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import row_index
from tsalign.operators.durable import durable

#: Cells, rows that fit their centres, rows of an index block and of a query block.
CELLS, SAMPLE, BLOCK, QUERIES = 16, 4096, 4096, 1024
#: Width of the error bound in standard deviations.
CONFIDENCE = 3.0
#: Bytes of query vectors that meet the index at once.
QUERY_BYTES = 16_000_000


def usable(vector: Column) -> Column:
    """Whether a vector takes part, its length apart."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def rotation(d: int, seed: int = 7) -> np.ndarray:
    """A random rotation of ``d`` dimensions."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, cells: int = CELLS, rounds: int = 10, seed: int = 11) -> np.ndarray:
    """k-means centres of a bounded sample, ordered as they fall."""
    cells = max(1, min(cells, len(sample) // 8))
    out = sample[np.random.default_rng(seed).choice(len(sample), cells, replace=False)]
    for _ in range(rounds):
        near = _nearest(sample, out)
        out = np.stack([sample[near == c].mean(axis=0) if (near == c).any() else out[c] for c in range(cells)])
    return out


def _nearest(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.argmin((to**2).sum(axis=1) - 2 * x @ to.T, axis=1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, distances from the centre, and inner products of the unit vectors with their codes."""
    around = x - centre
    far = np.sqrt((around**2).sum(axis=1))
    unit = (around / np.where(far > 0, far, 1)[:, None]) @ turn.T
    own = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(unit > 0, axis=1), far, np.where(far > 0, own, 1.0)


def bounds(q: np.ndarray, code: np.ndarray, far: np.ndarray, own: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Lower and upper bounds of the squared distances of queries (rows) and coded vectors (columns)."""
    d = q.shape[1]
    around = (q - centre) @ turn.T
    length = np.sqrt((around**2).sum(axis=1))[:, None]
    sign = np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1
    inner = (around.astype(np.float32) @ sign.T) / (np.sqrt(d) * own)
    error = CONFIDENCE * np.sqrt(np.maximum(1 - own**2, 0) / own**2 / max(d - 1, 1)) * length + 1e-6 * length
    squared = length**2 + far**2
    return squared - 2 * far * (inner + error), squared - 2 * far * (inner - error)


_BLOCK_SCHEMA = "cell int, ids binary, codes binary, scalars binary, vectors binary"


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _index(middle, turn):
    """Rows of a task to blocks of one cell each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column("vec_id").to_numpy(), _matrix(batch.column("vector"))
            cell = _nearest(x, middle)
            out = []
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                for at in range(0, len(rows), BLOCK):
                    few = rows[at : at + BLOCK]
                    code, far, own = encode(x[few], middle[c], turn)
                    out.append((int(c), ids[few].tobytes(), code.tobytes(), np.stack([far, own]).tobytes(), x[few].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))], _BLOCK_SCHEMA.replace(",", "").split()[::2]
            )

    return run


def _best(ids: np.ndarray, dist: np.ndarray, k: int) -> np.ndarray:
    if len(ids) > k:
        near = np.flatnonzero(dist <= np.partition(dist, k - 1)[k - 1])
        return near[np.lexsort((ids[near], dist[near]))[:k]]
    return np.lexsort((ids, dist))


def _search(middle, turn, k):
    """Block pairs of a task to the ``k`` nearest found per query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(turn)
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"]).reshape(-1, d)
                code = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                far, own = np.frombuffer(row["scalars"]).reshape(2, -1)
                names, q = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vectors"]).reshape(-1, d)
                # no vector of the block is nearer than its cell's centre less the block's radius
                nearest = np.sqrt(((q - middle[row["cell"]]) ** 2).sum(axis=1)) - far.max() * (1 + 1e-9)
                last = np.array([have[1][-1] if (have := kept.get(n)) is not None and len(have[0]) == k else np.inf for n in names.tolist()])
                open_ = np.flatnonzero(nearest <= last * (1 + 1e-9))
                if not len(open_):
                    continue
                names, q = names[open_], q[open_]
                low, high = bounds(q, code, far, own, middle[row["cell"]], turn)
                for i, name in enumerate(names.tolist()):
                    own_id = ids == name
                    top = high[i][~own_id] if own_id.any() else high[i]
                    reach = np.partition(top, k - 1)[k - 1] if len(top) >= k else np.inf
                    have = kept.get(name)
                    if have is not None and len(have[0]) == k:
                        reach = min(reach, have[1][-1] ** 2 * (1 + 1e-9))
                    pick = np.flatnonzero((low[i] <= reach) & ~own_id)
                    if not len(pick):
                        continue
                    dist = np.sqrt(((x[pick] - q[i]) ** 2).sum(axis=1))
                    found = ids[pick]
                    if have is not None:
                        found, dist = np.concatenate([have[0], found]), np.concatenate([have[1], dist])
                    best = _best(found, dist, k)
                    kept[name] = found[best], dist[best]
        if kept:
            counts = [len(v[0]) for v in kept.values()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(list(kept), np.int64), counts)),
                    pa.array(np.concatenate([v[0] for v in kept.values()])),
                    pa.array(np.concatenate([v[1] for v in kept.values()])),
                ],
                ["query_id", "vec_id", "score"],
            )

    return run


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, QUERIES):
            part = batch.slice(at, QUERIES)
            ids, x = part.column("vec_id").to_numpy(), _matrix(part.column("vector"))
            columns = [part.column("part").slice(0, 1), pa.array([ids.tobytes()]), pa.array([x.tobytes()])]
            yield pa.RecordBatch.from_arrays(columns, ["part", "q_ids", "q_vectors"])


def neighbours(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each query among all other rows.

    ``is_query`` is a condition on the columns of ``vectors``.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("asks")
    ).where(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    schema = "query_id long, vec_id long, score double"
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = common["d"]
    rows = rows.where(F.size("vector") == d)
    fitted = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vector").toArrow()
    middle, turn = centres(_matrix(fitted.column("vector").combine_chunks())), rotation(d)
    queries = rows.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    per_part = max(1, QUERY_BYTES // (8 * d + 8))
    queries = row_index(queries, [], ["vec_id"], "number")
    queries = durable(queries.select("vec_id", "vector", F.floor(F.col("number") / per_part).cast("int").alias("part")), "queries")
    parts = (queries.agg(F.max("part")).first()[0] or 0) + 1
    index = durable(rows.select("vec_id", "vector").mapInArrow(_index(middle, turn), _BLOCK_SCHEMA), "codes")
    found = None
    for part in range(parts):
        asked = queries.where(F.col("part") == part).coalesce(1).mapInArrow(_query_blocks, "part int, q_ids binary, q_vectors binary")
        # at most QUERY_BYTES of queries go to every index block: parts are cut by their row number
        pairs = index.withColumn("part", F.lit(part)).join(F.broadcast(asked), "part")
        near = pairs.drop("part").mapInArrow(_search(middle, turn, k), schema)
        found = near if found is None else found.unionByName(near)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
