"""Monthly archives: the same rows as from plain files, in a task per member, with errors that name the archive."""

import zipfile

import pytest

from tsalign.sources import files, zipped

HEAD = ",".join(files.RAW_KLINE_COLUMNS)


def line(ms, price, tail=""):
    return f"{ms},{price},{price + 1},{price - 1},{price},5{tail or ',0,0,0,0,0,0'}"


JAN = [line(1_704_067_200_000 + 3_600_000 * i, 10 + i) for i in range(40)]
FEB = [line(1_706_745_600_000 + 3_600_000 * i, 90 + i) for i in range(30)]


@pytest.fixture
def folder(tmp_path):
    texts = {
        "X-1h-2024-01": "\n".join([HEAD, *JAN[::-1], JAN[3]]) + "\n",
        "X-1h-2024-02": "\r\n".join(["open_time," + HEAD[10:], JAN[0].replace("10", "77", 1), *FEB, "bad,,,,,,,,,,,", line(1_706_745_700_000, 5, ",,,,,,")]),
        "X-1h-2024-04": "",
        "Y-1h-2024-01": "\n".join(JAN),
    }
    (tmp_path / "csv").mkdir()
    (tmp_path / "zip").mkdir()
    for name, text in texts.items():
        (tmp_path / "csv" / f"{name}.csv").write_bytes(text.encode())
        with zipfile.ZipFile(tmp_path / "zip" / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("notes.txt", "not data")
            z.writestr(f"{name}.csv", text)
    return tmp_path


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_equals_plain_files(spark, folder):
    plain = files.read_monthly(spark, str(folder / "csv"), "X-1h-", "2024-01-15", "2024-05-01")
    packed = files.read_monthly_zipped(spark, str(folder / "zip"), "X-1h-", "2024-01-15", "2024-05-01")
    assert packed.schema == plain.schema and rows(packed) == rows(plain) and len(rows(plain)) == 71
    assert files.read_monthly_zipped(spark, str(folder / "zip"), "X-1h-", "2025-01-01", "2025-03-01").count() == 0
    assert files.read_monthly_zipped(spark, str(folder / "none"), "X-1h-", "2024-01-01", "2024-03-01").count() == 0
    assert files.read_monthly_zipped(spark, str(folder / "zip"), "X-1h-", "2024-03-01", "2024-01-01").count() == 0


def test_a_task_per_member_and_only_the_columns_asked_for(spark, folder):
    df = zipped.read_zipped(spark, str(folder / "zip"), files.RAW_KLINE_COLUMNS, ["close"], "X-*.zip")
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["close", "_file", "_line"]
    assert df.where("_line = 1 AND _file LIKE '%2024-01.zip!X-1h-2024-01.csv'").first().close == "49"


def test_members_in_many_blocks(spark, folder, monkeypatch):
    want = rows(files.read_monthly_zipped(spark, str(folder / "zip"), "X-1h-", "2024-01-01", "2024-03-01"))
    reader = zipped.ZippedReader(zipped.ZippedCsv({"columns": HEAD}).schema(), {"folder": str(folder / "zip"), "columns": HEAD, "archives": "X-*2024-01.zip"})
    monkeypatch.setattr(zipped, "BLOCK", 150)
    (part,) = reader.partitions()
    batches = list(reader.read(part))
    assert len(batches) > 10 and [i for b in batches for i in b.column("_line").to_pylist()] == list(range(42))
    assert want


@pytest.mark.parametrize("harm", ["directory", "data", "text"])
def test_a_broken_archive_is_named(spark, folder, harm):
    path = folder / "zip" / "X-1h-2024-01.zip"
    data = bytearray(path.read_bytes())
    if harm == "directory":
        data = data[:-30]
    elif harm == "data":
        data[200:210] = b"\x00" * 10
    else:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("a.csv", JAN[0] + "\n1,2,3\n")
        data = path.read_bytes()
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="X-1h-2024-01.zip"):
        files.read_monthly_zipped(spark, str(folder / "zip"), "X-1h-", "2024-01-01", "2024-03-01").collect()


def test_written_archives_read_back(spark, tmp_path):
    df = spark.createDataFrame([(i % 3, f"2024-0{1 + i % 2}", i, f"v,{i}") for i in range(20)], "s int, month string, at int, text string")
    out = zipped.write_zipped(df, str(tmp_path / "out"), ["s", "month"], "s{}/{}", ["at", "text"], "at")
    assert sorted(r.rows for r in out.collect()) == [3, 3, 3, 3, 4, 4]
    back = zipped.read_zipped(spark, str(tmp_path / "out"), ["at", "text"], ["text", "at"], "s*/*.zip")
    assert sorted((int(r["at"]), r.text) for r in back.collect()) == [(i, f"v,{i}") for i in range(20)]


def test_several_series_from_one_scan(spark, folder):
    both = files.read_monthly_series(spark, str(folder / "csv"), {"Y": "Y-1h-", "X": "X-1h-"}, "2024-01-01", "2024-06-01")
    assert {(r.asset, r.ordinal, r["count"]) for r in both.groupBy("asset", "ordinal").count().collect()} == {("Y", 0, 40), ("X", 1, 71)}
    x = files.read_monthly(spark, str(folder / "csv"), "X-1h-", "2024-01-01", "2024-06-01")
    assert sorted(rows(both.where("asset = 'X'").drop("asset", "ordinal")), key=repr) == sorted(rows(x), key=repr)
    assert files.read_monthly_series(spark, str(folder / "csv"), {}, "2024-01-01", "2024-06-01").count() == 0
