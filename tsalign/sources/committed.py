"""Tables that exist once they are committed: parts in attempt folders, named by a manifest that is written last.

A write goes to a folder of its own. Only when Spark has finished it, a manifest
with the parts, their rows, files and bytes and the table's schema is written
beside them and renamed to the next version number. Readers take the newest
version and hold its parts against the listing: a table without a manifest, or
with a part that is not as the manifest says, is not present. So a killed write
leaves nothing that counts, whatever files it left; two writers cannot both take
one version, and the later one fails.

Rows are counted from the written files' footers. Only file names and sizes pass
through the driver. Old parts stay until :func:`clean` removes what the newest
manifest does not name.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[tuple[str, int, bool]]:
    """``(name, bytes, is folder)`` of what lies in a folder, by name; nothing if there is no such folder."""
    at, system = _system(spark, path)
    if not system.exists(at):
        return []
    return sorted((s.getPath().getName(), s.getLen(), s.isDirectory()) for s in system.listStatus(at))


def _read(spark: SparkSession, path: str) -> str:
    at, system = _system(spark, path)
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    at, system = _system(spark, path)
    stream = system.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _files(spark: SparkSession, path: str) -> dict[str, int]:
    found = [(n, size) for n, size, folder in children(spark, path) if not folder and not n.startswith(("_", "."))]
    return {"files": len(found), "bytes": sum(size for _, size in found)}


def _versions(spark: SparkSession, path: str) -> list[str]:
    return [n for n, _, _ in children(spark, f"{path}/_manifest") if n[:8].isdigit() and n.endswith(".json")]


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest manifest of a table, None unless its parts are there as it says."""
    versions = _versions(spark, path)
    if not versions:
        return None
    try:
        known = json.loads(_read(spark, f"{path}/_manifest/{versions[-1]}"))
        parts = [(p["folder"], {"files": p["files"], "bytes": p["bytes"]}) for p in known["parts"]]
    except (ValueError, KeyError, TypeError):
        return None
    return known if all(_files(spark, f"{path}/{folder}") == said for folder, said in parts) else None


def commit(df: DataFrame, path: str, append: bool = False) -> dict:
    """Write ``df`` as the whole table, or as a further part of it, and return the new manifest."""
    spark = df.sparkSession
    before = manifest(spark, path) if append else None
    versions = _versions(spark, path)
    folder = f"part-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{path}/{folder}")
    schema = spark.read.parquet(f"{path}/{folder}").schema
    if before is not None and json.loads(before["schema"]) != json.loads(schema.json()):
        raise ValueError(f"{path} holds other columns: {T.StructType.fromJson(json.loads(before['schema'])).simpleString()}")
    rows = spark.read.schema(schema).parquet(f"{path}/{folder}").count()
    part = {"folder": folder, "rows": rows, **_files(spark, f"{path}/{folder}")}
    parts = [*(before["parts"] if before else []), part]
    known = {"rows": sum(p["rows"] for p in parts), "parts": parts, "schema": schema.json()}
    number = int(versions[-1][:8]) + 1 if versions else 1
    attempt, final = f"{path}/_manifest/.{uuid.uuid4().hex}", f"{path}/_manifest/{number:08d}.json"
    _write(spark, attempt, json.dumps(known))
    source, system = _system(spark, attempt)
    target, _ = _system(spark, final)
    if system.exists(target) or not system.rename(source, target):
        raise RuntimeError(f"another writer committed version {number} of {path}")
    return known


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The committed rows of a table, None if it is not present."""
    known = manifest(spark, path)
    if known is None:
        return None
    schema = T.StructType.fromJson(json.loads(known["schema"]))
    return spark.read.schema(schema).parquet(*[f"{path}/{p['folder']}" for p in known["parts"]])


def clean(spark: SparkSession, path: str) -> list[str]:
    """Delete the parts that the newest manifest does not name, and return them; without a manifest nothing goes."""
    known = manifest(spark, path)
    if known is None:
        return []
    named = {p["folder"] for p in known["parts"]}
    gone = [n for n, _, folder in children(spark, path) if folder and n.startswith("part-") and n not in named]
    for name in gone:
        at, system = _system(spark, f"{path}/{name}")
        system.delete(at, True)
    return gone


def partitions(spark: SparkSession, path: str, key: str) -> Sequence[str]:
    """The values of ``key=value`` folders."""
    return [n[len(key) + 1 :] for n, _, folder in children(spark, path) if folder and n.startswith(f"{key}=")]
