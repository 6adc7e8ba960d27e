"""Feature tables bucketed by row key."""

import uuid

import pytest
from pyspark.sql import functions as F

from tsalign.operators.joins import zip_modalities
from tsalign.sources.bucketed import row_key, write_bucketed, zip_bucketed

KEYS = ["asset", "row_idx"]


@pytest.fixture
def written(spark, tmp_path):
    names = []

    def write(df, buckets=6):
        name = f"bucketed_{uuid.uuid4().hex}"
        names.append(name)
        write_bucketed(df, name, str(tmp_path / name), KEYS, buckets)
        return name

    yield write
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def modality(spark, rows, column):
    return spark.createDataFrame(rows, f"asset string, row_idx long, {column} double")


def keyed(n):
    return [(["A", "B", None][i % 3], None if i == 7 else i // 3) for i in range(n)]


def tables(spark, n):
    return [modality(spark, [(*k, float(i * f)) for i, k in enumerate(keyed(n))], c) for f, c in ((1, "x"), (2, "y"), (3, "z"))]


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_equals_the_joined_tables_and_moves_no_row(spark, written):
    parts = tables(spark, 200)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        glued = zip_bucketed(spark, [written(p.repartition(5)) for p in parts], KEYS)
        plan = glued._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert glued.columns == ["asset", "row_idx", "x", "y", "z"]
        assert sorted_rows(glued) == sorted_rows(zip_modalities(parts, KEYS))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_file_per_bucket(spark, written, tmp_path):
    name = written(tables(spark, 200)[0].repartition(7))
    files = [f for f in (tmp_path / name).iterdir() if f.suffix == ".parquet"]
    assert 0 < len(files) <= 6
    assert spark.table(name).count() == 200


def test_missing_rows(spark, written):
    a, b, _ = tables(spark, 9)
    short = b.where("y <> 4")
    first, second = written(a), written(short)
    with pytest.raises(Exception, match="a modality lacks row"):
        zip_bucketed(spark, [first, second], KEYS).collect()
    rows = {r.x: r.y for r in zip_bucketed(spark, [first, second], KEYS, missing="null").collect()}
    assert len(rows) == 9 and rows[2.0] is None and rows[3.0] == 6.0
    with pytest.raises(Exception, match="the first modality lacks row"):
        zip_bucketed(spark, [second, first], KEYS, missing="null").collect()
    with pytest.raises(ValueError):
        zip_bucketed(spark, [first], KEYS, missing="drop")


def test_edges(spark, written):
    a, b, _ = tables(spark, 3)
    assert zip_bucketed(spark, [written(a.limit(0)), written(b.limit(0))], KEYS).collect() == []
    one = written(a)
    assert sorted_rows(zip_bucketed(spark, [one], KEYS)) == sorted_rows(a)
    with pytest.raises(ValueError):
        write_bucketed(a.withColumn("row_key", F.lit(1)), "x", "/nowhere", KEYS, 2)


def test_row_keys_are_distinct(spark):
    values = [("a", "b"), ("a1:b", None), (None, "a1:b"), ("-", None), (None, "-"), ("", ""), ("", None), (None, ""), (None, None), ("ab", "")]
    df = spark.createDataFrame(values, "k string, l string")
    assert df.select(row_key(["k", "l"])).distinct().count() == len(values)
