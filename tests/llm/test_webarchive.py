import hashlib
import io
import random
import struct
import zipfile
import zlib

import pytest

from tsalign.llm import webarchive as wa
from tsalign.operators.durable import scratch_folder

SCHEMA = "page_id bigint, url string, html string, digest string, payload int, first int"
LONG = "long page é " * 20


def pages():
    return [
        (5, "http://a/%20?x=1", LONG), (3, "http://b\r\nX: y", LONG), (9, None, LONG), (4, "u", "short"), (6, "u", "short"), (7, "v", None), (8, "v", ""),
        (10, "w", "x" * 100), (11, "w", "x" * 100), (12, "w", "x" * 99), (13, "w", "x" * 99), (3, "again", LONG), (None, "n", LONG), (20, "big", "q\r\n\r\n" * 100_000),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2) for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = first.get(h) if first.get(h) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to, u))
    return sorted(map(str, out))


def test_round_trip(spark):
    got = sorted(str(tuple(r)) for r in wa.round_trip(frame(spark, pages()).repartition(3)).collect())
    assert got == expected(pages())


def test_small_archives_and_ranges(spark):
    folder = f"{scratch_folder(spark)}/test-archives-{random.random()}"
    rows = wa.plan_records(frame(spark, pages()))
    archives = wa.write_archives(rows, folder, archive_records=2)
    assert archives.count() >= 7 and {r.records for r in archives.collect()} <= {1, 2}
    read = wa.read_records(wa.locate(archives)).collect()
    assert len(read) == len(pages())
    for r in read:
        assert r.payload is None if r.record_type == "revisit" else hashlib.sha256(r.payload).hexdigest() == r.declared


def test_empty_table(spark):
    assert wa.round_trip(frame(spark, [])).count() == 0


def _zip(name, data, method=zipfile.ZIP_STORED, comment=b"", extra=(), wide=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        with z.open(name, "w", force_zip64=wide) as f:
            f.write(data)
        for n, d in extra:
            z.writestr(n, d)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("before", [b"", b"#!/bin/sh\n" * 9])
@pytest.mark.parametrize("comment", [b"", b"PK\5\6 in a comment, long enough to look real"])
def test_directory(before, comment):
    data = before + _zip("archive/a.warc", b"hello" * 100, comment=comment, extra=[("indexes/i.cdx", "x")], wide=True)
    found = {n: (m, data[at : at + size]) for n, m, at, size in wa.directory(io.BytesIO(data), len(data))}
    assert found == {"archive/a.warc": (0, b"hello" * 100), "indexes/i.cdx": (0, b"x")}


def test_zip64_directory():
    many = 66_000
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(many):
            z.writestr(f"{i}", b"")
    data = out.getvalue()
    assert b"PK\6\7" in data[-100:] and sum(1 for _ in wa.directory(io.BytesIO(data), len(data))) == many


def test_zip64_fields():
    """An entry whose sizes and offset stand in its ZIP64 field, as for members beyond 4 GB."""
    name, body = b"archive/x.warc", b"W" * 10
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(body), 2**32 - 1, 2**32 - 1, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 10, 10)
    field = struct.pack("<HHQQQ", 1, 24, 10, 10, 0)
    entry = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(body), 2**32 - 1, 2**32 - 1, len(name), len(field), 0, 0, 0, 0, 2**32 - 1) + name + field
    at = len(local) + len(body)
    wide = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    end = b"PK\6\7" + struct.pack("<IQI", 0, at + len(entry), 1) + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 2**16 - 1, 2**16 - 1, 2**32 - 1, 2**32 - 1, 0)
    data = local + body + entry + wide + end
    assert list(wa.directory(io.BytesIO(data), len(data))) == [("archive/x.warc", 0, len(local), 10)]


@pytest.mark.parametrize("packed", [False, True])
def test_archives_without_an_index(spark, tmp_path, packed):
    records = [wa.record(f"{i}", "u", b"p" * i, "d", None) for i in range(5)]
    data = b"".join(zlib.compress(r, wbits=31) if packed else r for r in records)
    path = tmp_path / "a.wacz"
    path.write_bytes(_zip("archive/data.warc.gz" if packed else "archive/data.warc", data, extra=[("other.txt", "no")]))
    ranges = wa.locate(spark.createDataFrame([(str(path),)], "path string"))
    assert sorted(len(r.payload) for r in wa.read_records(ranges).collect()) == [0, 1, 2, 3, 4]
