"""Image sizes from headers, and epoch batches from a keyed permutation."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from tsalign.operators.profile import image_sample_report
from tsalign.operators.split import epoch_batches, permuted, round_keys
from tsalign.sources import images


def test_headers():
    good = images.png_header(640, 480)
    assert images.png_size(good) == images.png_size(good + b"more") == (640, 480)
    flip = lambda i: good[:i] + bytes([good[i] ^ 1]) + good[i + 1 :]
    assert all(images.png_size(flip(i)) is None for i in range(len(good)))
    assert images.png_size(b"") is images.png_size(good[:-1]) is images.png_size(images.png_header(0, 5)) is None


def test_report_from_a_folder(spark, tmp_path):
    files = {"btc/10.png": images.png_header(4, 2) + b"x" * 9, "btc/20.png": images.png_header(4, 2), "btc/30.png": b"not an image at all, but long enough", "eth/10.png": b""}
    for name, data in {**files, "eth/note.txt": b"?", "eth/x.png": b"?"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    sizes = images.read_image_sizes(spark, str(tmp_path))
    got = {(r.asset, r.unix_ts): (r.width, r.height, r.bytes) for r in sizes.collect()}
    assert got == {("BTC", 10): (4, 2, 42), ("BTC", 20): (4, 2, 33), ("BTC", 30): (None, None, 36)}  # empty files are not listed
    expected = spark.createDataFrame([("BTC", t) for t in (10, 20, 30, 40)], "asset string, unix_ts long")
    covered = images.image_coverage(expected, sizes, ["asset", "unix_ts"])
    assert {r.unix_ts: r.found for r in covered.collect()} == {10: True, 20: True, 30: True, 40: False}
    r = image_sample_report(covered, "path", "width", "height").first()
    assert (r["rows"], r.valid, r.invalid, r.resolutions, r.dominant, r.coverage_pct) == (4, 2, 2, 1, "4x2", 50.0)
    gone = spark.createDataFrame([(str(tmp_path / "gone.png"), 1), (None, 2)], "path string, k int")
    assert {(r.k, r.bytes, r.width) for r in images.with_png_size(gone).collect()} == {(1, None, None), (2, None, None)}


def plain(x, n, seed, epoch):
    prime = 2**31 - 1
    for k, a, b, c in round_keys(seed, epoch):
        mirror = (k - x) % n
        z = (max(x, mirror) % prime * a + b) % prime
        x = mirror if (z * z + c) % prime >> 16 & 1 else x
    return x


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1000, 4099])
def test_permutation(spark, n):
    rows = spark.range(n).select("id", permuted(F.col("id"), F.lit(n), 5).alias("p")).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and [r.p for r in rows] == [plain(r.id, n, 5, 0) for r in rows]


def test_permutation_looks_shuffled(spark):
    n = 20_000
    orders = [[r.p for r in spark.range(n).select(permuted(F.col("id"), F.lit(n), 5, e).alias("p")).collect()] for e in (0, 1)]
    for order in [*orders, [p for _, p in sorted(zip(orders[0], orders[1]))]]:
        mean = (n - 1) / 2
        corr = sum((i - mean) * (p - mean) for i, p in enumerate(order)) / sum((i - mean) ** 2 for i in range(n))
        near = sum(abs(a - b) < 200 for a, b in zip(order, order[1:]))
        assert abs(corr) < 0.04 and near < 0.04 * n
        thirds = [sum(p < n // 3 for p in order[i::3]) for i in range(3)]
        assert max(thirds) - min(thirds) < 400
    big = 10**12 + 39
    few = spark.range(big - 3, big).select(permuted(F.col("id"), F.lit(big), 1).alias("p")).collect()
    assert all(0 <= r.p < big for r in few) and len({r.p for r in few}) == 3


def test_epochs_move_no_row(spark):
    df = spark.createDataFrame([(i, 10, "x") for i in range(10)] + [(None, 10, "y")], "at long, n long, v string")
    epochs = [epoch_batches(df, "at", "n", 4, e) for e in range(3)]
    assert "Exchange" not in epochs[0]._jdf.queryExecution().executedPlan().toString()
    seen = [sorted((r.batch_idx, r.in_batch, r["at"]) for r in e.collect() if r["at"] is not None) for e in epochs]
    assert all([(b, i) for b, i, _ in s] == [(b, i) for b in range(2) for i in range(4)] for s in seen)
    assert seen[0] != seen[1] != seen[2] and seen[0] == sorted((r.batch_idx, r.in_batch, r["at"]) for r in epochs[0].collect() if r["at"] is not None)
    whole = epoch_batches(df, "at", "n", 4, drop_last=False).collect()
    assert len(whole) == 11 and reduce(lambda s, r: s | {(r.batch_idx, r.in_batch)}, whole, set()) == {(i // 4, i % 4) for i in range(10)} | {(None, None)}
