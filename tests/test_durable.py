"""Intermediate tables live as long as their application, or until they are cleared."""

import subprocess
import sys
from pathlib import Path

import pytest

from tsalign.operators.durable import clear_scratch, durable, scratch_folder
from tsalign.operators.sample import sample_positions
from tsalign.operators.split import batches
from tsalign.operators.windows import keep_last_n

ROOT = Path(__file__).resolve().parent.parent

SCRIPT = """
import sys
from pyspark.sql import SparkSession
from tsalign.operators.durable import durable
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
assert durable(spark.range(3)).count() == 3
spark.stop()
"""


def test_cleared_on_request(spark):
    kept = durable(spark.range(5), "five")
    folder = Path(scratch_folder(spark).removeprefix("file:"))
    assert kept.count() == 5 and list(folder.glob("five-*"))
    clear_scratch(spark)
    assert not folder.exists()
    assert durable(spark.range(5), "five").count() == 5


def test_gone_with_the_application(tmp_path):
    subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=ROOT, check=True, timeout=120, capture_output=True)
    assert not list((tmp_path / "tsalign").glob("*/*"))


@pytest.fixture
def sparse(spark):
    """Ids spread over 60 bits, so that no two share a run of consecutive values."""
    return spark.range(3000).selectExpr("xxhash64(id) & 1152921504606846975 AS id", "id % 7 AS run")


def test_sparse_ids(sparse):
    ids = sorted(r.id for r in sparse.collect())
    placed = {r.id: r.batch_idx for r in batches(sparse, "id", 64).collect()}
    assert placed == {v: i // 64 for i, v in enumerate(ids)}
    picked = {r.id: r.sample_pos for r in sample_positions(sparse, "id", 50).collect()}
    assert len(picked) == 50 and all(ids[p] == v for v, p in picked.items())


def test_keep_last_of_large_runs(sparse):
    runs = {}
    for r in sparse.collect():
        runs.setdefault(r.run, []).append(r.id)
    kept = {(r.run, r.id) for r in keep_last_n(sparse, ["run"], "id", 3).where("keep").collect()}
    assert kept == {(k, v) for k, vs in runs.items() for v in sorted(vs)[-3:]}
