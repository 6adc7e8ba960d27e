"""Web archives packaged as ZIP files: write them, and range-read their records without extraction.

An archive holds one WARC file, ``archive/data.warc.gz`` (a gzip member for each
record), stored without further compression, and ``indexes/index.cdxj``, a line
for each record with its place in the WARC file. A reader takes the central
directory from the end of the archive (ZIP64 directories included), finds the
stored members and the indexes, and reads just the byte ranges of the records.
Archives without an index are walked record by record.

Archives live in a folder that all executors reach, given as a URI that Arrow's
file systems open. A task writes archives of bounded size under names of its
own and reports them; what an attempt that failed has left is never listed.

Defined results: a NULL payload is empty; a NULL id, URL or referred id is left
out of the record and read back as NULL; control characters in them are
percent-coded; records with equal payloads of at least ``REVISIT_BYTES`` bytes
are revisits of the one with the smallest id, which stays a response together
with rows that repeat its id; where all their ids are NULL, all are responses;
compressed members are listed but not read; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsalign.llm.common import measured, whole_texts
from tsalign.operators.durable import durable, scratch_folder

#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 100
#: An archive is closed at this many bytes or records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 64_000_000, 50_000
#: Bytes read at once where ranges touch.
READ_BYTES = 8_000_000
#: Bytes of records that one task reads at most.
TASK_BYTES = 64_000_000
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f%<>]")


def _safe(value: str) -> str:
    return _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", value)


def record(name: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit without payload if ``refers_to`` is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}"]
    if name is not None:
        head.append(f"WARC-Record-ID: <{_safe(name)}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_safe(refers_to)}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Type, id, URL, referred id, declared digest and payload (NULL for a revisit) of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields.get("content-length", len(rest)))]
    kind = fields.get("warc-type")
    payload = None
    if kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block

    def bare(key: str) -> str | None:
        value = fields.get(key)
        return None if value is None else unquote(value.removeprefix("<").removesuffix(">"))

    return {
        "record_id": bare("warc-record-id"),
        "record_type": kind,
        "url": bare("warc-target-uri"),
        "refers_to": bare("warc-refers-to"),
        "declared": fields.get("warc-payload-digest", "").removeprefix("sha256:") or None,
        "payload": payload,
    }


def _write(folder: str, archive_bytes: int, archive_records: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        done, state = [], {}

        def close() -> None:
            state["member"].close()
            state["zip"].writestr("indexes/index.cdxj", "".join(state["lines"]))
            state["zip"].close()
            state["out"].close()
            done.append((f"{folder}/{state['name']}", len(state["lines"])))
            state.clear()

        for batch in batches:
            for row in batch.to_pylist():
                if not state:
                    state["name"] = f"{uuid.uuid4().hex}.wacz"
                    state["out"] = store.open_output_stream(f"{root}/{state['name']}")
                    state["zip"] = zipfile.ZipFile(state["out"], "w", zipfile.ZIP_STORED)
                    state["member"] = state["zip"].open("archive/data.warc.gz", "w", force_zip64=True)
                    state["lines"], state["size"] = [], 0
                packer = zlib.compressobj(4, wbits=31)
                data = record(row["name"], row["url"], row["payload"], row["digest"], row["refers_to"])
                data = packer.compress(data) + packer.flush()
                line = {"url": row["url"], "offset": state["size"], "length": len(data), "filename": "data.warc.gz"}
                state["lines"].append(json.dumps(line) + "\n")
                state["member"].write(data)
                state["size"] += len(data)
                if state["size"] >= archive_bytes or len(state["lines"]) >= archive_records:
                    close()
        if state:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], ["path", "records"]
        )

    return run


def write_archives(
    records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, archive_records: int = ARCHIVE_RECORDS
) -> DataFrame:
    """Write ``records`` (``name, url, payload, digest, refers_to``); ``path, records`` of each archive."""
    rows = records.select(
        F.col("name").cast("string"), F.col("url").cast("string"), F.col("payload").cast("binary"), "digest", F.col("refers_to").cast("string")
    )
    return durable(whole_texts(rows).mapInArrow(_write(folder, archive_bytes, archive_records), "path string, records long"), "archives")


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Which pages become responses and which revisits: ``name, url, payload, digest, refers_to``."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("name"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.sha2("payload", 256)
    )
    again = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("name").alias("first"), F.count("*").alias("n"))
    again = measured(again.where("n > 1").select(F.col("digest").alias("known"), "first"), "again")
    joined = rows.join(again, F.col("digest") == F.col("known"), "left")
    refers = F.when(F.col("name").isNull() | (F.col("name") != F.col("first")), F.col("first"))
    return joined.select("name", "url", "payload", "digest", refers.alias("refers_to"))


def _take(file, at: int, n: int) -> bytes:
    file.seek(at)
    return file.read(n)


def directory(file, size: int) -> Iterator[tuple[str, int, int, int]]:
    """``(member, method, start of its data, stored size)`` from the central directory of an open archive."""
    tail = _take(file, max(0, size - 65_557), min(size, 65_557))
    end = tail.rfind(b"PK\5\6")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\5\6", 0, end)
    if end < 0:
        raise ValueError("no end of central directory")
    entries, length, start = struct.unpack_from("<HII", tail, end + 10)
    end_at = size - len(tail) + end
    locator = _take(file, end_at - 20, 20) if end_at >= 20 else b""
    if locator[:4] == b"PK\6\7":
        wide_at = struct.unpack_from("<Q", locator, 8)[0]
        wide = _take(file, wide_at, 56)
        if wide[:4] != b"PK\6\6":  # bytes stand before the archive
            wide_at = end_at - 20 - 56
            wide = _take(file, wide_at, 56)
        if wide[:4] != b"PK\6\6":
            raise ValueError("no ZIP64 end of central directory")
        entries, length, start = struct.unpack_from("<QQQ", wide, 32)
        end_at = wide_at
    before = end_at - length - start
    at, pending = start + before, b""
    for _ in range(entries):
        while len(pending) < 46 or len(pending) < 46 + sum(struct.unpack_from("<HHH", pending, 28)):
            more = _take(file, at, 1 << 20)
            if not more:
                raise ValueError("the central directory ends early")
            pending, at = pending + more, at + len(more)
        if pending[:4] != b"PK\1\2":
            raise ValueError("not a central directory entry")
        method = struct.unpack_from("<H", pending, 10)[0]
        packed, full = struct.unpack_from("<II", pending, 20)
        n, m, k = struct.unpack_from("<HHH", pending, 28)
        offset = struct.unpack_from("<I", pending, 42)[0]
        name, extra = pending[46 : 46 + n].decode("utf-8", "replace"), pending[46 + n : 46 + n + m]
        pending = pending[46 + n + m + k :]
        while len(extra) >= 4:
            tag, width = struct.unpack_from("<HH", extra)
            if tag == 1:
                wide = list(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                full = wide.pop(0) if full == 0xFFFFFFFF else full
                packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + width :]
        local = _take(file, offset + before, 30)
        if local[:4] != b"PK\3\4":
            raise ValueError(f"no local header for {name}")
        yield name, method, offset + before + 30 + sum(struct.unpack_from("<HH", local, 26)), packed


def _walk(file, start: int, size: int) -> Iterator[tuple[int, int]]:
    """Offsets and lengths of the records of a WARC member without an index, compressed or not."""
    at = 0
    if size and _take(file, start, 2) == b"\x1f\x8b":
        while at < size:
            unpack, used = zlib.decompressobj(wbits=31), 0
            while not unpack.eof and at + used < size:
                part = _take(file, start + at + used, min(1 << 16, size - at - used))
                unpack.decompress(part)
                used += len(part) - len(unpack.unused_data)
            yield at, used
            at += used
        return
    while at < size:
        head = b""
        while b"\r\n\r\n" not in head and at + len(head) < size:
            head += _take(file, start + at + len(head), min(1 << 14, size - at - len(head)))
        top = head.partition(b"\r\n\r\n")[0]
        found = re.search(rb"(?im)^content-length:\s*(\d+)", top)
        n = min(len(top) + 8 + int(found[1]) if found else size - at, size - at)
        yield at, n
        at += n


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, where = fs.FileSystem.from_uri(path)
            found: list[tuple[str, int, int]] = []
            with store.open_input_file(where) as file:
                members = list(directory(file, file.size()))
                stored = {name: (at, n) for name, method, at, n in members if method == 0}
                warcs = {name: v for name, v in stored.items() if re.search(r"\.warc(\.gz)?$", name)}
                listed = set()
                for name, (at, n) in stored.items():
                    if re.match(r"indexes/.*\.cdxj?(\.gz)?$", name):
                        text = _take(file, at, n)
                        text = zlib.decompress(text, wbits=31) if name.endswith(".gz") else text
                        for line in io.BytesIO(text):
                            entry = json.loads(line[line.index(b"{") :])
                            member = f"archive/{entry['filename']}"
                            listed.add(member)
                            found.append((path, warcs[member][0] + int(entry["offset"]), int(entry["length"])))
                for name, (at, n) in warcs.items():
                    if name not in listed:
                        found += [(path, at + offset, length) for offset, length in _walk(file, at, n)]
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pylist([dict(zip(("path", "start", "length"), f)) for f in found[at : at + 10_000]])


def locate(archives: DataFrame) -> DataFrame:
    """``path, start, length``: the byte range of every record in the archives of ``archives`` (``path``)."""
    tasks = min(archives.count(), 4 * archives.sparkSession.sparkContext.defaultParallelism)
    spread = archives.select("path").repartition(max(tasks, 1), "path")
    return spread.mapInArrow(_locate, "path string, start long, length long")


_RECORD = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "url", "refers_to", "declared")] + [("payload", pa.binary())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, file = None, None
    for batch in batches:
        rows, i = batch.to_pylist(), 0
        while i < len(rows):
            if rows[i]["path"] != path:
                if file is not None:
                    file.close()
                path = rows[i]["path"]
                store, where = fs.FileSystem.from_uri(path)
                file = store.open_input_file(where)
            start, end, k = rows[i]["start"], rows[i]["start"] + rows[i]["length"], i + 1
            while k < len(rows) and rows[k]["path"] == path and rows[k]["start"] == end and end - start < READ_BYTES:
                end += rows[k]["length"]
                k += 1
            data = memoryview(_take(file, start, end - start))
            out = []
            for row in rows[i:k]:
                one = data[row["start"] - start :][: row["length"]]
                out.append(parse_record(zlib.decompress(one, wbits=31) if bytes(one[:2]) == b"\x1f\x8b" else bytes(one)))
            yield pa.RecordBatch.from_pylist(out, _RECORD)
            i = k
    if file is not None:
        file.close()


def read_records(ranges: DataFrame) -> DataFrame:
    """The records at ``ranges`` (``path, start, length``): id, type, URL, referred id, declared digest and payload."""
    ranges = durable(ranges, "ranges")
    total = ranges.agg(F.sum("length")).first()[0] or 0
    # a stated number of tasks, by bytes: the table of ranges is so small that it would end in one
    parts = max(-(-total // TASK_BYTES), min(-(-total // (1 << 20)), ranges.sparkSession.sparkContext.defaultParallelism), 1)
    spread = ranges.repartitionByRange(int(parts), "path", "start").sortWithinPartitions("path", "start")
    schema = "record_id string, record_type string, url string, refers_to string, declared string, payload binary"
    return whole_texts(spread).mapInArrow(_read, schema)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each page, read all archives back, and describe each record by its full payload.

    ``page_id, payload_bytes, payload_digest, record_type, refers_to, url``; the
    payload of a revisit is that of the response it refers to.
    """
    spark = pages.sparkSession
    folder = f"{scratch_folder(spark)}/archives-{uuid.uuid4().hex}"
    archives = write_archives(plan_records(pages, id_col, url_col, payload_col), folder)
    read = read_records(locate(archives)).select(
        F.col("record_id").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"),
        "record_type",
        F.col("refers_to").cast("long").alias("refers_to"),
        "url",
    )
    read = durable(read, "records")
    wanted = read.where("refers_to IS NOT NULL").select(F.col("refers_to").alias("page_id")).distinct()
    origin = read.where("record_type = 'response'").join(wanted, "page_id", "left_semi").groupBy(F.col("page_id").alias("of"))
    origin = origin.agg(F.min("payload_bytes").alias("bytes"), F.min("payload_digest").alias("digest"))
    joined = read.join(measured(origin, "origins"), F.col("refers_to") == F.col("of"), "left")
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "bytes").alias("payload_bytes"),
        F.coalesce("payload_digest", "digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        "url",
    )


def oracle() -> str:
    return f"""
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, url, octet_length(encode(t)) AS n, sha256(t) AS h FROM p),
        f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= {REVISIT_BYTES} GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
            CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to, url
        FROM d LEFT JOIN f USING (h)"""
