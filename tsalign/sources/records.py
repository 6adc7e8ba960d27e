"""Delimited files with line breaks inside quotes, read in many tasks per file.

Whether a block of a file begins inside a quoted field depends on all text before
it. So each block first says where it would end from either state, a prefix over
the (small) table of blocks then gives every block its true state, and in a second
scan each block cuts its lines into records. What a block's first and last lines
hold of a record that crosses its edges is put together afterwards; these are at
most two fragments per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tsalign.operators.durable import durable

#: Blocks (of ``spark.sql.files.maxPartitionBytes``) of one read; their states go to every executor, about 100 bytes each.
BLOCKS = 1_000_000

_ORDER = ["_file", "_block", "_line"]


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open after ``line``. A quote opens a field only as its first character; two inside are one."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside, at = False, at + 1
        elif line.startswith('"', at):
            inside, at = True, at + 1
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("value"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: the states after it if it begins outside and inside a quoted field, and whether its first line ends in CR."""
    at, state = None, None
    for batch in batches:
        values, files, blocks = (batch.column(c).to_pylist() for c in ("value", "_file", "_block"))
        done = []
        for value, *place in zip(values, files, blocks):
            if place != at:
                if at is not None:
                    done.append((*at, *state))
                at, state = place, [False, True, value.endswith("\r")]
            if '"' in value:
                state[0], state[1] = ends_inside(value, state[0]), ends_inside(value, state[1])
        if done:
            yield _batch(done)
    if at is not None:
        yield _batch([(*at, *state)])


_STATES = "_file string, _block long, outside boolean, inside boolean, cr boolean"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["_file", "_block", "outside", "inside", "cr"])


def block_states(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``_file, _block, begins`` (inside a quoted field or not) and ``cr`` (the file's lines end in CR LF)."""
    blocks = _lines(spark, path).mapInArrow(_blocks, _STATES)
    order = Window.partitionBy("_file").orderBy("_block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block keeps the state, swaps it, or ends in one state whatever it was
    swap = F.col("outside") & ~F.col("inside")
    fixed = F.when(F.col("outside") == F.col("inside"), F.col("outside").cast("int"))
    swaps = F.coalesce(F.sum(swap.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    placed = blocks.withColumns({"_fixed": fixed + swaps, "_swaps": swaps})
    state = F.coalesce(F.last("_fixed", True).over(before), F.lit(0)) + F.coalesce(F.last("_swaps").over(before), F.lit(0))
    return placed.select("_file", "_block", (state % 2 == 1).alias("begins"), F.first("cr").over(order).alias("cr"))


_WHOLE, _TAIL, _HEAD = 0, 1, 2


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to records; ``kind`` tells whole ones from the last (open) and first (not begun here) fragments of a block."""
    at, inside, held, kind, number, cr = None, False, [], _WHOLE, 0, False

    def flush(closed: bool):
        return (*at, number, kind if kind == _HEAD or closed else _TAIL, "\n".join(held))

    for batch in batches:
        out = []
        values, files, blocks, begins, crs = (batch.column(c).to_pylist() for c in ("value", "_file", "_block", "begins", "cr"))
        for value, file, block, starts, file_cr in zip(values, files, blocks, begins, crs):
            if [file, block] != at:
                if held:
                    out.append(flush(False))
                at, inside, held, kind, number, cr = [file, block], starts, [], _HEAD if starts else _WHOLE, 0, file_cr
            if cr and value.endswith("\r"):
                value = value[:-1]
            held.append(value)
            if '"' in value:
                inside = ends_inside(value, inside)
            if not inside:
                out.append(flush(True))
                held, kind, number = [], _WHOLE, number + 1
        if out:
            yield _records(out)
    if held:
        yield _records([flush(False)])


_RECORD = "_file string, _block long, _line long, kind int, record string"


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["_file", "_block", "_line", "kind", "record"])


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``_file, _block, _line, record``: every record of the files as text, at the place where it begins, empty ones left out."""
    states = durable(block_states(spark, path).select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), "begins", "cr"), "blocks")
    if states.count() > BLOCKS:
        raise ValueError(f"more than {BLOCKS} file blocks; raise spark.sql.files.maxPartitionBytes")
    # a row per block of a file; a shuffle would take the lines out of their order
    lines = _lines(spark, path).join(F.broadcast(states), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))).drop("_f", "_b")
    cut = lines.mapInArrow(_cut, _RECORD)
    whole = cut.where(F.col("kind") == _WHOLE).drop("kind")
    # first fragments belong to the last open one before them, of whatever earlier block
    parts = cut.where(F.col("kind") != _WHOLE).withColumn("_seq", F.struct("_block", F.col("kind") == _TAIL))
    order = Window.partitionBy("_file").orderBy("_seq").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.last(F.when(F.col("kind") == _TAIL, F.struct("_block", "_line")), True).over(order)
    joined = parts.withColumn("_begun", begun).groupBy("_file", "_begun").agg(F.sort_array(F.collect_list(F.struct("_seq", "record"))).alias("parts"))
    stitched = joined.select("_file", "_begun._block", "_begun._line", F.array_join(F.col("parts.record"), "\n").alias("record"))
    return whole.unionByName(stitched).where("record <> ''")


def read_csv_records(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` as text with the file order; as ``spark.read.csv(header=True, multiLine=True, escape='"')``, but splittable.

    ``columns`` names all fields of the files, in order; each file begins with a header.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    first = (F.col("_block") == 0) & (F.col("_line") == 0)
    rows = csv_records(spark, path).where(~first)
    parsed = rows.select(F.from_csv("record", schema, {"escape": '"'}).alias("row"), *_ORDER)
    return parsed.select("row.*", *_ORDER)
