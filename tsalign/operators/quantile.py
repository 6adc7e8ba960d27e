"""Exact quantiles that scale: a sketch brackets each wanted rank, and only the values inside a bracket are sorted.

Spark's ``percentile`` keeps every distinct value of a group in one task, and
sorting all values moves the whole table. Here one aggregate sketches every
group, and a second reads the values once more: it counts those below each
bracket as one and the few inside (about one in a thousand of a large group)
each. The counts are range-sorted and ranked by the number of rows before their
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsalign.operators.chunk import arrange, earlier, join_keys
from tsalign.operators.durable import durable

SKETCH = 10_000
"""Accuracy of the sketch: a rank is off by at most one in this many rows. Smaller groups are sorted whole."""


def melt(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Rows ``(by, feature, value)`` for the non-NULL values of ``cols``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(*by, F.inline(pairs)).where(F.col("value").isNotNull())


def quantiles(df: DataFrame, by: Sequence[str], cols: Sequence[str], probs: dict[str, float]) -> DataFrame:
    """``{name: p}`` per ``(by, feature)``, linear interpolation between neighbours."""
    keys = [*by, "feature"]
    values = melt(df, by, cols)
    # four sketch errors on either side leave three for the ranks next to the wanted one
    reach = 4.0 / SKETCH
    edges = [e for p in probs.values() for e in (max(0.0, p - reach), min(1.0, p + reach))]
    sketch = values.groupBy(*keys).agg(
        F.count("value").alias("_total"),
        F.min("value").alias("_min"),
        F.max("value").alias("_max"),
        F.percentile_approx("value", F.array(*map(F.lit, edges)), F.lit(SKETCH)).alias("_edge"),
    )
    small = F.col("_total") <= SKETCH
    wanted = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    brackets = [
        F.struct(
            F.lit(i).alias("which"),
            wanted(p).alias("rank"),
            F.when(small, F.col("_min")).otherwise(F.col("_edge")[2 * i]).alias("low"),
            F.when(small, F.col("_max")).otherwise(F.col("_edge")[2 * i + 1]).alias("high"),
        )
        for i, p in enumerate(probs.values())
    ]
    brackets = durable(sketch.select(*keys, F.array(*brackets).alias("_brackets")), "brackets")

    value = F.col("value")
    # what lies below a bracket is counted as one NULL, which sorts before the values inside: one pass for both
    met = F.filter("_brackets", lambda b: value <= b["high"])
    met = join_keys(values, brackets, keys).select(*keys, "value", F.explode(met).alias("_b"))
    met = met.select(*keys, "_b.which", "_b.rank", F.when(value >= F.col("_b.low"), value).alias("value"))
    counted = met.groupBy(*keys, "which", "rank", "value").agg(F.count(F.lit(1)).alias("rows"))
    counted = arrange(counted, [*keys, "which"], ["value"])

    slots = [*keys, "which"]
    parts = counted.groupBy(*slots, "_part").agg(F.sum("rows").alias("_n"))
    parts = parts.select(*slots, "_part", F.coalesce(F.sum("_n").over(earlier(slots, "_part")), F.lit(0)).alias("_before"))
    parts = durable(parts, "parts")

    ranked = join_keys(counted, parts, [*slots, "_part"])
    so_far = Window.partitionBy(*slots, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = ranked.withColumn("_hi", F.sum("rows").over(so_far) + F.col("_before"))
    at = lambda k: F.max(F.when((F.col("_hi") - F.col("rows") <= k) & (k < F.col("_hi")), value))
    rank = F.col("rank")
    picked = ranked.groupBy(*slots).agg(at(F.floor(rank)).alias("_b"), at(F.ceil(rank)).alias("_a"), F.max(rank - F.floor(rank)).alias("_f"))
    found = F.col("_b") + (F.col("_a") - F.col("_b")) * F.col("_f")
    found = F.coalesce(found, F.raise_error(F.lit("a wanted rank fell outside its bracket")).cast("double"))
    picked = picked.select(*keys, "which", found.alias("_q"))
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == i, F.col("_q"))).alias(m) for i, m in enumerate(probs)])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def with_fences(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The melted values with their group's quartiles and 1.5 IQR fences."""
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quantiles(df, by, cols, QUARTILES).withColumns({"lower": F.col("q1") - reach, "upper": F.col("q3") + reach})
    return join_keys(melt(df, by, cols), durable(fences, "fences"), [*by, "feature"])
