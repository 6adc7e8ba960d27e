import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsalign.llm import threshold

SCHEMA = "vec_id bigint, embedding array<float>, label int, vector int, anchor int, part int, score long, place int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 1, 2, 3, 4, 5) for i, v, l in rows], SCHEMA)


def brute(rows, every, shift=True, d=6):
    use = []
    for i, v, l in rows:
        if i is None or l is None or not v or len(v) != d or any(y is None or not math.isfinite(y) for y in v):
            continue
        use.append((i, [math.floor(256 * float(np.float32(y))) for y in v], (l + 1) % 10 if shift and i % 7 == 0 else l))
    anchors = {}
    for i, v, l in use:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (v, l)), (v, l))
    out = []
    for a, (v, label) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, l) for i, w, l in use if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:5]:
            fit = [(n, i) for n, i, l in scored if l != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, p, r, i, -s, -n) for r, (n, i) in enumerate(fit, 1)]
    return sorted(out)


def data(n=900, seed=2, labels=4):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(labels, 6))
    rows = [(i, (middles[i % labels] * 0.7 + rng.normal(size=6)).tolist(), int(rng.choice([i % labels, 0]))) for i in range(n)]
    rows += [(n + i, rows[11][1], i % 3) for i in range(30)]  # ties
    rows += [(50, rows[3][1], 1), (13, rows[4][1], 2), (13, rows[4][1], 2)]  # repeated ids
    odd = [(None, 1), ([], 1), ([1.0] * 5, 1), ([1.0] * 5 + [None], 1), ([float("nan")] * 6, 1), ([float("inf")] * 6, 1), ([0.0] * 6, 1), ([1.0] * 6, None)]
    return rows + [(5000 + 50 * i, v, l) for i, (v, l) in enumerate(odd)] + [(None, rows[0][1], 1)]


def mined(spark, rows, every=50, **how):
    out = threshold.mine(frame(spark, rows).repartition(3), F.col("vec_id") % every == 0, **how)
    assert out.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("block,step", [(4096, 8), (64, 1), (50, 3)])
def test_against_brute_force(spark, monkeypatch, block, step):
    monkeypatch.setattr(threshold, "BLOCK", block)
    monkeypatch.setattr(threshold, "STEP", step)
    want = brute(data(), 50)
    assert len(want) > 150 and mined(spark, data(), label=threshold.shifted_label()) == want


def test_anchors_in_several_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(threshold, "ANCHOR_BYTES", 900)
    monkeypatch.setattr(threshold, "ANCHORS", 4)
    assert mined(spark, data(300), 20) == brute(data(300), 20, shift=False)


def test_components_beyond_double_precision(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * 2.0**16).tolist(), i % 2) for i in range(200)] + [(900, [3e5] * 6, 1), (901, [1e5] * 6, 1), (902, [2e5] * 6, 0)]
    assert mined(spark, rows) == brute(rows, 50, shift=False)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, None, 1), (50, [1.0] * 6, None)]) == []
    assert mined(spark, [(0, [1.0] * 6, 1), (1, [1.0] * 6, 1)]) == []
    assert mined(spark, [(3, [1.0] * 6, 1), (1, [1.0] * 6, 1)]) == []
    rows = [(0, [1.0] * 6, 1), (1, [1.0] * 6, 1), (2, [0.9] * 6, 2), (3, [0.0] * 6, 2), (4, [-1.0] * 6, 1), (5, [0.99] * 6, 3)]
    assert [r[:4] for r in mined(spark, rows)] == [(0, 1, 1, 2)]


def test_the_threshold_stops_before_all_rows_are_met():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(4000, 3)))
    lists = np.ascontiguousarray(np.argsort(x, axis=0).T.astype(np.uint16))
    row = {"ids": np.arange(4000).tobytes(), "labels": np.zeros(4000, np.int64).tobytes(), "vectors": x.tobytes(), "lists": lists.tobytes()}
    block, anchor, best = threshold._Block(row, 3), np.array([256.0, -300.0, 0.0]), threshold._Best(5)
    scored = threshold._hunt(block, anchor, np.ones(4000, dtype=bool), [best])
    assert scored < 2000
    assert best.found == sorted((-int(s), i) for i, s in enumerate(x @ anchor))[:5]
