"""Hard-negative mining by Fagin's threshold algorithm on integer inner products.

An anchor's positives are the best rows of its label; for each of them, the hard
negatives are the best rows of other labels whose score lies within a window
below the positive's score.

1. Rows become index blocks where they are read, without a shuffle: the scaled
   vectors and, for each dimension, the block's rows in ascending order of their
   component. The index is written once.
2. Blocks of anchors meet the index blocks, a bounded number of anchors at a time.
   In a block, an anchor reads all lists in step, from the end that its component's
   sign makes the better one, and scores each row it meets once, by random access.
   The sum of the anchor's components times the values last read bounds every row
   not yet met. It stops once that threshold is strictly below the score of the
   last one wanted, so ties are settled among rows that were all met; a window is
   finished as well once the threshold is below its lower edge.
3. A task keeps the best rows of its blocks for every anchor, and what it already
   has narrows the search in later blocks. Few rows per anchor and task leave it.

The first pass finds the positives, the second one the negatives of all windows of
an anchor at once. Scores are exact: in double precision while no sum can reach
2^53, else in Python's integers. A score beyond 64 bits is an error.

Defined results: rows with a NULL id, a NULL label, a NULL or empty vector or NULL
or non-finite components take no part, nor do vectors of another length than the
most frequent one (the smaller at a tie); zero vectors do; ties go to the smaller
id; an anchor whose id repeats uses its smallest vector and, of equal ones, label,
and never finds rows of its own id; other repeated rows are candidates each, and
positives each; a negative positive score leaves an empty window; with fewer
candidates all are returned; other columns are ignored, whatever their names; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import row_index
from tsalign.operators.durable import durable

#: Units of a component.
SCALE = 256
#: Edges of the window, in hundredths of the positive's score.
LOW, HIGH = 50, 95
#: Rows of an index block and of a block of anchors; bytes of anchors that meet the index at once.
BLOCK, ANCHORS, ANCHOR_BYTES = 4096, 512, 16_000_000
#: Entries read from each list in the first step; every step doubles them.
STEP = 8

_EXACT = 2.0**53
_INDEX = "ids binary, labels binary, vectors binary, lists binary"
_RESULT = "anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"


class _Block:
    """Rows with one sorted list per dimension."""

    def __init__(self, row: dict, d: int):
        self.ids, self.labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
        self.x = np.frombuffer(row["vectors"]).reshape(-1, d)
        self.lists = np.frombuffer(row["lists"], np.uint16).reshape(d, -1)
        self.largest = np.abs(self.x).max()

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products with ``anchor``, exact."""
        if self.largest * np.abs(anchor).max() * len(anchor) < _EXACT:
            return (self.x[rows] @ anchor).astype(np.int64)
        return np.array([sum(int(p) * int(q) for p, q in zip(x, anchor)) for x in self.x[rows]], dtype=object)

    def access(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, object]]:
        """``(rows met for the first time, bound of the scores of all others)`` after each step; None when all were met."""
        m = len(self.ids)
        used = np.flatnonzero(anchor)
        lists = np.where((anchor[used] > 0)[:, None], self.lists[used, ::-1], self.lists[used])
        fast = self.largest * np.abs(anchor).max() * len(anchor) < _EXACT
        met, at, step = np.zeros(m, dtype=bool), 0, STEP
        while at < m and len(used):
            fresh = np.zeros(m, dtype=bool)
            fresh[lists[:, at : at + step].ravel()] = True
            fresh &= ~met
            met |= fresh
            at += step
            if at >= m or met.all():
                break
            last = self.x[lists[:, at - 1], used]
            bound = int(last @ anchor[used]) if fast else sum(int(p) * int(q) for p, q in zip(last, anchor[used]))
            yield np.flatnonzero(fresh), bound
            step *= 2
        else:
            fresh = ~met
        yield np.flatnonzero(fresh), None


class _Best:
    """The ``k`` best ``(score, id)`` within inclusive edges, higher scores and then smaller ids first."""

    def __init__(self, k: int, low=None, high=None):
        self.k, self.low, self.high = k, low, high
        self.found: list[tuple[int, int]] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        inside = np.ones(len(scores), dtype=bool)
        if self.high is not None:
            inside &= (100 * scores <= self.high).astype(bool) & (100 * scores >= self.low).astype(bool)
        if len(self.found) == self.k:
            inside &= (scores >= -self.found[-1][0]).astype(bool)
        if not inside.any():
            return
        scores, ids = scores[inside], ids[inside]
        if len(scores) > self.k and scores.dtype != object:
            enough = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[enough], ids[enough]
        self.found = sorted([*self.found, *zip((-scores).tolist(), ids.tolist())])[: self.k]

    def done(self, bound) -> bool:
        """Whether no row of at most this score can still enter."""
        if self.low is not None and (self.low > self.high or 100 * bound < self.low):
            return True
        return len(self.found) == self.k and bound < -self.found[-1][0]


def _hunt(block: _Block, anchor: np.ndarray, wanted: np.ndarray, goals: list[_Best]) -> int:
    """Add the block's wanted rows to the goals; how many rows were scored."""
    scored = 0
    if not wanted.any() or all(g.low is not None and g.low > g.high for g in goals):
        return scored
    for rows, bound in block.access(anchor):
        rows = rows[wanted[rows]]
        scored += len(rows)
        if len(rows):
            scores, ids = block.scores(rows, anchor), block.ids[rows]
            for goal in goals:
                goal.add(scores, ids)
        if bound is None or all(g.done(bound) for g in goals):
            break
    return scored


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            x = np.floor(SCALE * _matrix(part.column("vector")))
            lists = np.ascontiguousarray(np.argsort(x, axis=0, kind="stable").T.astype(np.uint16))
            cells = [part.column("vec_id").to_numpy(), part.column("label").to_numpy(), x, lists]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cells], ["ids", "labels", "vectors", "lists"])


def _anchor_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ANCHORS):
            part = batch.slice(at, ANCHORS)
            x = np.floor(SCALE * _matrix(part.column("vector")))
            cells = [part.column("vec_id").to_numpy().tobytes(), part.column("label").to_numpy().tobytes(), x.tobytes()]
            goals = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), pa.concat_arrays([part.column("goals")]))
            yield pa.RecordBatch.from_arrays([*[pa.array([c], pa.binary()) for c in cells], goals], ["a_ids", "a_labels", "a_vectors", "a_goals"])


_GOALS = "array<struct<positive_id: long, positive_score: long>>"
_ASKED = f"a_ids binary, a_labels binary, a_vectors binary, a_goals array<{_GOALS}>"


def _search(d: int, k: int) -> Callable:
    """Pairs of index and anchor blocks to the best rows per anchor, or per anchor and window where there are goals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[_Best]] = {}
        windows: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row, d)
                anchors = np.frombuffer(row["a_vectors"]).reshape(-1, d)
                names, labels = np.frombuffer(row["a_ids"], np.int64).tolist(), np.frombuffer(row["a_labels"], np.int64).tolist()
                for name, label, anchor, goals in zip(names, labels, anchors, row["a_goals"]):
                    if name not in kept:
                        windows[name] = goals
                        kept[name] = [_Best(k, LOW * g["positive_score"], HIGH * g["positive_score"]) for g in goals] or [_Best(k)]
                    same = block.labels == label
                    _hunt(block, anchor, (~same if goals else same) & (block.ids != name), kept[name])
        out = []
        for name, bests in kept.items():
            for place, best in enumerate(bests):
                goal = windows[name][place] if windows[name] else {"positive_id": None, "positive_score": None}
                out += [(name, place, goal["positive_id"], goal["positive_score"], i, -s) for s, i in best.found]
        if out:
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _RESULT.replace(",", "").split()[::2])

    return run


def _pass(index: DataFrame, anchors: DataFrame, parts: int, d: int, k: int) -> DataFrame:
    """The ``k`` best rows for every anchor (``part, vec_id, label, vector, goals``), a bounded part of the anchors at a time."""
    found = None
    for part in range(parts):
        asked = anchors.where(F.col("part") == part).select("vec_id", "label", "vector", "goals").coalesce(1)
        asked = asked.mapInArrow(_anchor_blocks, _ASKED).withColumn("part", F.lit(part))
        # at most ANCHOR_BYTES of anchors go to every index block: parts are cut by their row number
        met = index.withColumn("part", F.lit(part)).join(F.broadcast(asked), "part").drop("part").mapInArrow(_search(d, k), _RESULT)
        found = met if found is None else found.unionByName(met)
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the columns of ``vectors``, ``label`` an integer
    expression (the column ``label`` if not given).
    """
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & (F.size("vector") > 0))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], empty)
    d = common["d"]
    rows = rows.where(F.size("vector") == d)
    index = durable(rows.select("vec_id", "label", "vector").mapInArrow(_index, _INDEX), "index")
    anchors = rows.where("anchor").groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("row"))
    per_part = max(1, ANCHOR_BYTES // (8 * d + 100))
    anchors = row_index(anchors.select("vec_id", "row.label", "row.vector"), [], ["vec_id"], "number")
    anchors = durable(anchors.select("vec_id", "label", "vector", F.floor(F.col("number") / per_part).cast("int").alias("part")), "anchors")
    parts = (anchors.agg(F.max("part")).first()[0] or 0) + 1
    first = _pass(index, anchors.withColumn("goals", F.array().cast(_GOALS)), parts, d, positives)
    goals = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda g: F.struct(g["vec_id"].alias("positive_id"), g["score"].alias("positive_score"))).alias("goals")
    )
    second = _pass(index, durable(anchors.join(goals, "vec_id"), "goals"), parts, d, negatives)
    return second.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_label(id_col: str = "vec_id", label_col: str = "label") -> Column:
    """The label, one further (of ten) where the id is divisible by seven."""
    return F.when(F.col(id_col) % 7 == 0, (F.col(label_col) + 1) % 10).otherwise(F.col(label_col))


def oracle(every: int = 50, positives: int = 5, negatives: int = 3) -> str:
    """The same in SQL, for anchors with an id divisible by ``every`` and :func:`shifted_label`; one row per id, one length."""
    return f"""
        WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % {every} = 0),
        best AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM best JOIN scores USING (anchor_id)
        WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
        QUALIFY rank <= {negatives}"""
