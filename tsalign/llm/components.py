"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured
from tsalign.operators.durable import durable


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node around it.

    Only nodes with a smaller neighbour have anything to look up; the hub of a
    large group has none, so its many edges never meet in a join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = measured(both.groupBy("a").agg(F.min("b").alias("m")).where("m < a"), "least")
    up = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return up.join(least, "a", "left").select(F.col("b").alias("a"), F.coalesce("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them; nodes with one such neighbour stay as they are."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    ends = down.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("x"))
    several = measured(ends.where("m <> x").select("a", "m"), "several")
    moved = down.join(several, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(ends.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b``, integers): the smallest node it is connected with.

    Alternates large-star and small-star steps until the edges no longer change,
    in a number of rounds that grows with the logarithm of the longest path.
    Each round is written to the shared folder, so neither plan nor recovery
    grows with the rounds. Loops and repeated edges are allowed; nodes without
    an edge to another node are not returned.
    """
    edges = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = F.expr("bit_xor(xxhash64(a, b))"), F.count("*")
    before = edges.agg(*mark).first()
    while before[1]:
        edges = durable(_small_star(durable(_large_star(edges), "raised")), "edges")
        after = edges.agg(*mark).first()
        if after == before:
            break
        before = after
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
