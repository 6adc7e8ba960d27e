"""Near-duplicate documents by min-max hashing.

Each of ``PERMUTATIONS`` hash functions gives two signature values, its minimum
and its maximum over the shingle set, so a signature of 200 values costs 100
evaluations per shingle. ``BANDS`` bands of ``ROWS`` values name buckets; sets
that share a bucket are candidates. At similarity 0.75 a pair shares no bucket
with probability 2e-5.

Candidates are confirmed on full sets, and no group is ever in one task:

1. Documents with equal sets form a class; one representative goes on.
2. Each bucket links its members to its smallest member. The components of that
   graph are loose groups; everything that may be linked lies in one of them.
3. A loose group is cut into blocks of bounded bytes; each pair of blocks is one
   unit of work. Exact intersections come from products of 0/1 matrices over the
   shingles that occur more than once, and a unit returns a spanning forest of
   its links, never all pairs.
4. The components of all forests are the answer.

Sets hold 64-bit hashes of shingles.

Defined results: NULL, empty and blank texts have no shingle and are linked with
nothing; a text of one to four words is one shingle; rows that repeat an id keep
their own set and all get their answer; rows with a NULL id are linked with
nothing and kept, with a NULL component; other columns are ignored or kept
unchanged; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured, mix, whole_texts
from tsalign.llm.components import components
from tsalign.llm.shingles import shingle_sets
from tsalign.operators.durable import durable

U64 = np.uint64
PERMUTATIONS, ROWS = 100, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Links need 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: Bytes of shingle sets in a block at most; blocks that a group is cut into even if it is smaller, and their least bytes.
BLOCK_BYTES, BLOCKS, LEAST_BYTES = 8_000_000, 8, 250_000
#: Rows and columns of a matrix.
CHUNK, COLUMNS = 512, 8192

_FACTOR = mix(np.arange(11, 11 + PERMUTATIONS, dtype=U64)) | U64(1)
_SHIFT = mix(np.arange(100_011, 100_011 + PERMUTATIONS, dtype=U64))
_BAND = mix(np.arange(200_011, 200_011 + ROWS, dtype=U64)) | U64(1)
_SALT = mix(np.arange(300_011, 300_011 + BANDS, dtype=U64))


def signature(s: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, ``2 * PERMUTATIONS`` values; ``s`` must not be empty."""
    low = np.full(PERMUTATIONS, np.iinfo(U64).max, dtype=U64)
    high = np.zeros(PERMUTATIONS, dtype=U64)
    for at in range(0, len(s), 1024):
        x = s[None, at : at + 1024] * _FACTOR[:, None]
        x += _SHIFT[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1).ravel()


def bands(s: np.ndarray) -> np.ndarray:
    """The bucket of each band."""
    values = signature(s).reshape(BANDS, ROWS)
    return mix((values * _BAND).sum(axis=1, dtype=U64) ^ _SALT)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, names, values, ends = [], [], [np.empty(0, dtype=U64)], [0]
        for s in shingle_sets(batch.column("text").to_pylist()):
            n.append(len(s))
            names.append(f"{int(s.sum(dtype=U64)):016x}{int(mix(s ^ U64(77)).sum(dtype=U64)):016x}")
            if len(s):
                values.append(bands(s))
            ends.append(ends[-1] + (BANDS if len(s) else 0))
        buckets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n, pa.int64()), pa.array(names, pa.string()), buckets], ["doc", "n", "set_id", "bands"]
        )


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc``, its set size ``n``, ``set_id`` (128 bits that name the set) and its ``bands``."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return whole_texts(texts).mapInArrow(_sketch, "doc long, n long, set_id string, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column("text").to_pylist())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("grp"), sets], ["node", "grp", "set"])


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, exact: shingles of one set only are left out, the rest become matrix columns."""
    sizes = [len(s) for s in left] + [len(s) for s in right]
    values, code, count = np.unique(np.concatenate(left + right), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    column = (np.cumsum(count > 1) - 1)[code]
    row = np.repeat(np.arange(len(sizes)), sizes)[shared]
    column = column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(left), len(right)), dtype=np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sizes), COLUMNS), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        total += np.rint(part[: len(left)] @ part[len(left) :].T).astype(np.int64)
    return total


def _forest(left: list[tuple[int, np.ndarray]], right: list[tuple[int, np.ndarray]] | None) -> list[tuple[int, int]]:
    """Links between two blocks (or inside one), without those that close a circle."""
    top: dict[int, int] = {}

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    found = []
    inside = right is None
    left = sorted(left, key=lambda x: len(x[1]))
    right = left if inside else sorted(right, key=lambda x: len(x[1]))
    for i in range(0, len(left), CHUNK):
        a = left[i : i + CHUNK]
        for k in range(i if inside else 0, len(right), CHUNK):
            b = right[k : k + CHUNK]
            if 100 * len(a[-1][1]) < THRESHOLD * len(b[0][1]) or 100 * len(b[-1][1]) < THRESHOLD * len(a[0][1]):
                continue
            common = _intersections([s for _, s in a], [s for _, s in b])
            na, nb = np.array([len(s) for _, s in a]), np.array([len(s) for _, s in b])
            linked = 100 * common >= THRESHOLD * (na[:, None] + nb[None, :] - common)
            for x, y in zip(*(v.tolist() for v in np.nonzero(linked))):
                p, q = find(a[x][0]), find(b[y][0])
                if p != q:
                    top[max(p, q)] = min(p, q)
                    found.append((a[x][0], b[y][0]))
    return found


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; a unit may span batches."""

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("grp", "i", "k", "block", "node", "set")))

    for (_, i, k), unit in groupby(rows(), key=lambda r: r[:3]):
        left, right = [], []
        for _, _, _, block, node, data in unit:
            (left if block == i else right).append((node, np.frombuffer(data, dtype=U64)))
        found = _forest(left, None if i == k else right) if left and (right or i == k) else []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def links(docs: DataFrame, members: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links ``a, b`` inside the loose groups of ``members`` (``node, grp``), a spanning forest for each unit of work."""
    texts = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    sets = durable(whole_texts(texts).join(members, "node").mapInArrow(_sets, "node long, grp long, set binary"), "sets")
    # an id that repeats may bring a set of its own; both belong to the node
    size = F.sum(F.length("set") + 64)
    blocks = F.greatest(F.ceil(size / BLOCK_BYTES), F.least(F.ceil(size / LEAST_BYTES), F.lit(BLOCKS)))
    sizes = sets.groupBy("grp").agg(blocks.cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = sets.join(measured(sizes, "blocks"), "grp").select("grp", "blocks", block.alias("block"), "node", "set")
    unit = F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) AS i, greatest(x, block) AS k))"))
    units = placed.select("grp", unit.alias("u"), "block", "node", "set").select("grp", "u.i", "u.k", "block", "node", "set")
    return units.repartition("grp", "i", "k").sortWithinPartitions("grp", "i", "k").mapInArrow(_links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    sketch = durable(sketches(docs, id_col, text_col), "sketches")
    full = sketch.where("doc IS NOT NULL AND n > 0")
    classes = durable(full.groupBy("set_id").agg(F.min("doc").alias("rep")), "classes")
    # the bands of a class are those of its representative's row
    reps = full.join(classes, ["set_id"]).where("doc = rep").select("rep", "bands").dropDuplicates(["rep", "bands"])
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    hubs = buckets.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub <> last")
    edges = buckets.join(hubs, "bucket").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    groups = components(edges).select(F.col("node"), F.col("component").alias("grp"))
    found = components(links(docs, measured(groups, "groups"), id_col, text_col))
    answer = classes.join(found, classes["rep"] == found["node"], "left").select(
        "set_id", F.coalesce("component", "rep").alias("component")
    )
    out = sketch.alias("s").join(
        answer.alias("a"), (F.col("s.set_id") == F.col("a.set_id")) & (F.col("s.n") > 0) & F.col("s.doc").isNotNull(), "left"
    )
    component = F.coalesce("component", "doc")
    return out.select(
        F.col("doc").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(True)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; all columns unchanged.

    Rows that repeat the kept id with the same set are copies too, and one of them stays.
    """
    marked = durable(near_duplicates(docs, id_col, text_col), "marked")
    kept = marked.where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("keep")).count()
    gone = marked.where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = measured(gone.join(kept, F.col("gone") == F.col("keep"), "left_anti"), "gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    left = rows.join(gone, F.col("doc") == F.col("gone"), "left_anti")
    if kept.where("count > 1").isEmpty():
        return left.select("row.*")
    keyed = left.where("doc IS NOT NULL").withColumn("h", F.sha2("text", 256)).dropDuplicates(["doc", "h"]).drop("h")
    return keyed.unionByName(left.where("doc IS NULL")).select("row.*")


def oracle() -> str:
    """The same in SQL: all pairs that share a shingle, and a recursive walk along the links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH RECURSIVE
        w AS (SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (
            SELECT x, y FROM pairs JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= {THRESHOLD} * (a.n + b.n - k)),
        edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach(doc_id, c) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.c = e.x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) USING (doc_id)"""
