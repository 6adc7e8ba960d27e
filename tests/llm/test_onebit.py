import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsalign.llm import onebit

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector int, asks string, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "a", 2) for i, v in rows], SCHEMA)


def brute(rows, k, asks):
    x = {}
    use = [(i, [float(np.float32(y)) for y in v]) for i, v in rows if i is not None and v and all(y is not None and math.isfinite(y) for y in v) and any(v) and len(v) == 8]
    for i, v in use:
        if asks(i):
            x[i] = min(v, x.get(i, v))
    out = []
    for q, v in x.items():
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w))), i) for i, w in use if i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return sorted(out)


def data(n=400, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(n, 8)) + rng.integers(0, 3, (n, 1)))]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(40)] + [(10, rows[10][1]), (10, rows[11][1])]
    odd = [None, [], [0.0] * 8, [1.0] * 7, [1.0] * 7 + [None], [float("nan")] * 8, [float("inf")] + [1.0] * 7]
    return rows + [(2000 + 10 * i, v) for i, v in enumerate(odd)] + [(None, same)]


def test_against_brute_force(spark):
    rows = data()
    got = onebit.neighbours(frame(spark, rows).repartition(4), F.col("vec_id") % 10 == 0)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got, want = sorted(map(tuple, got.collect())), brute(rows, 10, lambda i: i % 10 == 0)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    hits = sum(g[2] == w[2] and math.isclose(g[3], w[3], rel_tol=1e-12, abs_tol=1e-15) for g, w in zip(got, want))
    assert hits >= 0.99 * len(want)


def test_query_blocks_in_several_parts(spark, monkeypatch):
    rows = data(120)
    monkeypatch.setattr(onebit, "QUERY_BYTES", 1000)
    got = sorted(map(tuple, onebit.neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0).collect()))
    want = brute(rows, 10, lambda i: i % 5 == 0)
    assert sum(g[:3] == w[:3] for g, w in zip(got, want)) >= 0.99 * len(want) and len(got) == len(want)


def test_few_rows(spark):
    assert onebit.neighbours(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert onebit.neighbours(frame(spark, [(1, None), (0, [0.0, 0.0])]), F.col("vec_id") % 10 == 0).count() == 0
    got = onebit.neighbours(frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.5])]), F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 2), (2, 1)]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, q, c = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64)), rng.normal(size=64) / 4
    turn = onebit.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    low, high = onebit.bounds(q, *onebit.encode(x, c, turn), c, turn)
    true = ((q[:, None] - x[None]) ** 2).sum(axis=2)
    assert ((low <= true) & (true <= high)).mean() > 0.995
    assert abs(((low + high) / 2 - true).mean()) < 0.5


@pytest.mark.parametrize("n", [1, 3, 50])
def test_centres_of_small_samples(n):
    assert np.isfinite(onebit.centres(np.random.default_rng(n).normal(size=(n, 4)))).all()
