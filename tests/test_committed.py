"""Committed tables: what counts as present, after kills, changes and rival writers."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tsalign.sources import committed, sinks


def test_a_killed_write_is_redone_and_a_finished_one_stays(spark, tmp_path):
    path = str(tmp_path / "features")
    place = Path(path, "text", "split=train")
    (place / "part-dead" / "_temporary" / "0").mkdir(parents=True)
    spark.range(5).write.parquet(str(place / "part-half"))
    assert committed.read(spark, str(place)) is None and sinks.read_features(spark, path, "text") is None
    assert sinks.write_features({"text": spark.range(3)}, path, "train") == ["text"]
    assert sinks.write_features({"text": spark.range(9)}, path, "train") == []
    assert sorted(r.id for r in sinks.read_features(spark, path, "text", "train").collect()) == [0, 1, 2]
    assert sinks.write_features({"text": spark.range(9)}, path, "train", force=True) == ["text"]
    assert sinks.read_features(spark, path, "text").groupBy("split").count().collect() == [("train", 9)]


def test_a_failing_write_commits_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="lost"):
        committed.commit(bad, path)
    assert committed.manifest(spark, path) is None
    assert committed.commit(spark.range(4), path)["rows"] == 4


@pytest.mark.parametrize("harm", ["gone", "short", "extra", "broken", "empty"])
def test_parts_that_are_not_as_the_manifest_says(spark, tmp_path, harm):
    path = str(tmp_path / "t")
    committed.commit(spark.range(10).coalesce(1), path)
    (part,) = Path(path).glob("part-*/part-*.parquet")
    if harm == "gone":
        part.rename(tmp_path / "away")
    elif harm == "short":
        part.write_bytes(part.read_bytes()[:-5])
    elif harm == "extra":
        (part.parent / "more.parquet").write_bytes(part.read_bytes())
    else:
        (version,) = Path(path, "_manifest").glob("*.json")
        version.write_text("{" if harm == "broken" else "{}")
        Path(path, "_manifest", f".{version.name}.crc").unlink()
    assert committed.manifest(spark, path) is None and committed.read(spark, path) is None


def test_parts_are_added_and_old_ones_cleaned(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.commit(spark.range(3), path)
    assert committed.commit(spark.range(3, 7), path, append=True)["rows"] == 7
    assert committed.read(spark, path).count() == 7
    with pytest.raises(ValueError, match="other columns"):
        committed.commit(spark.range(1).select(F.lit("x").alias("y")), path, append=True)
    committed.commit(spark.range(2), path)
    assert len(committed.clean(spark, path)) == 3 and committed.clean(spark, path) == []
    assert committed.read(spark, path).count() == 2 and len(list(Path(path).glob("part-*"))) == 1


def test_rival_writers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    committed.commit(spark.range(3), path)
    stale = committed._versions(spark, path)[:0]
    monkeypatch.setattr(committed, "_versions", lambda *_: stale)
    with pytest.raises(RuntimeError, match="another writer"):
        committed.commit(spark.range(5), path)
    monkeypatch.undo()
    assert committed.read(spark, path).count() == 3


def test_empty_tables_are_present(spark, tmp_path):
    path = str(tmp_path / "t")
    committed.commit(spark.range(0), path)
    assert committed.read(spark, path).count() == 0 and committed.manifest(spark, path)["rows"] == 0
    assert json.loads(committed.manifest(spark, path)["schema"])["fields"][0]["name"] == "id"


def test_inventory_without_some_tables(spark, tmp_path):
    path = str(tmp_path / "features")
    sinks.write_features({"text": spark.range(3).select(F.array(F.lit(1.0)).alias("v"))}, path, "train")
    (row,) = sinks.feature_inventory(spark, path, dict.fromkeys(sinks.MODALITIES, "v")).collect()
    assert (row.split, row.text_rows, row.text_dim, row.image_rows, row.complete, row.equal_counts) == ("train", 3, 1, None, False, False)
    assert sinks.feature_inventory(spark, str(tmp_path / "none"), dict.fromkeys(sinks.MODALITIES, "v")).count() == 0
