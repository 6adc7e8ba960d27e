"""Runs above a threshold and kernel densities against plain versions; NULL keys in the joins of keys."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tsalign.operators.density import density
from tsalign.operators.islands import cascades
from tsalign.operators.joins import compare_to_claims, modality_counts_match, zip_modalities
from tsalign.operators.scale import apply_scaler, fit_standard
from tsalign.operators.windows import null_context


def plain(rows, at_least, least, bridge):
    out = []
    for key in {k for k, _, _ in rows}:
        run = []
        for p, v in [*sorted((p, v) for k, p, v in rows if k == key and v is not None and v >= at_least), (None, None)]:
            if run and (p is None or p - run[-1][0] > bridge + 1):
                if len(run) >= least:
                    out.append((key, run[0][0], run[-1][0], len(run), sum(v for _, v in run), max(v for _, v in run)))
                run = []
            run.append((p, v))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("bridge", "least", "rows"), [(0, 1, 4), (2, 2, 3), (6, 1, 4), (0, 3, 1000), (9, 1, 2)])
def test_cascades(spark, bridge, least, rows):
    rng = random.Random(bridge)
    data = []
    for key in ("a", None, "c"):
        level = 0
        for p in range(120):
            level = rng.choice([level, level, level, 1 - level])
            v = rng.choice([7, 8, 9]) if level else rng.choice([1, 2, None])
            data.append((key, p, 9 if key == "c" and 20 <= p < 90 else v))
    df = spark.createDataFrame(data, "k string, p long, v long").repartition(5)
    got = cascades(df, ["k"], "p", "v", 7, least, bridge, rows)
    assert got.columns == ["k", "first", "last", "n_rows", "total", "peak"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(data, 7, least, bridge)
    assert cascades(df, ["k"], "p", "v", 100, rows=rows).count() == 0 == cascades(df.limit(0), ["k"], "p", "v", 1).count()


def test_density_of_well_spread_values(spark):
    rng = random.Random(4)
    data = [(k, rng.gauss(m, 1.0)) for k, m in (("a", 0.0), (None, 5.0)) for _ in range(4000)] + [("one", 3.0), ("same", 2.0), ("same", 2.0), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    out = density(df, ["k"], ["v"], points=201).collect()
    for key, middle in (("a", 0.0), (None, 5.0)):
        rows = sorted((r.x, r.density) for r in out if r.k == key)
        step = rows[1][0] - rows[0][0]
        assert abs(sum(d for _, d in rows) * step - 1) < 0.02
        values = [v for k, v in data if k == key and v is not None]
        h = math.sqrt(sum((v - sum(values) / len(values)) ** 2 for v in values) / (len(values) - 1)) * len(values) ** -0.2
        for x, d in rows[40:160:20]:
            exact = sum(math.exp(-0.5 * ((x - v) / h) ** 2) for v in values) / (len(values) * h * math.sqrt(2 * math.pi))
            assert abs(d - exact) < 0.004
        assert abs(max(rows, key=lambda r: r[1])[0] - middle) < 0.5
    assert all(r.density is None for r in out if r.k in ("one", "same")) and len(out) == 4 * 201


def test_null_keys_match(spark):
    rows = [("a", 0, 1.0), ("a", 1, None), (None, 0, 3.0), (None, 1, None), (None, 2, 5.0)]
    df = spark.createDataFrame(rows, "k string, p long, v double")
    assert {(r.k, r.p) for r in null_context(df, ["k"], "p", "v", 1).collect()} == {("a", 0), ("a", 1), (None, 0), (None, 1), (None, 2)}
    scaled = apply_scaler(df, fit_standard(df, ["v"], ["k"]), ["v"], ["k"]).collect()
    assert sorted(r.v_scaled for r in scaled if r.k is None and r.v is not None) == [-1.0, 1.0]
    glued = zip_modalities([df.drop("v"), df], ["k", "p"])
    assert sorted(map(tuple, glued.collect()), key=repr) == sorted(rows, key=repr)
    assert {(r.k, r.rows_0, r.rows_1, r.equal) for r in modality_counts_match([df, df], ["k"]).collect()} == {("a", 2, 2, True), (None, 3, 3, True)}
    sums = df.groupBy("k").agg(F.sum("v").alias("actual"))
    claims = spark.createDataFrame([(None, 8.0), ("b", 1.0)], "k string, claimed double")
    assert {(r.k, r.actual, r.claimed, r.ok) for r in compare_to_claims(sums, claims, ["k"]).collect()} == {("a", 1.0, None, False), (None, 8.0, 8.0, True), ("b", None, 1.0, False)}
