"""Delimited files inside ZIP archives, as a Spark data source with a partition for each member.

Archives and their members are listed from the central directories (ranged reads,
side by side). A task inflates its member as a stream and parses it block by
block, so an archive is never in memory; of the declared columns only those that
the schema asks for are converted. Files are opened through Arrow's file systems
(local, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatchcase
from io import BytesIO

import pandas as pd
import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a member that are parsed at once, and archives that are listed side by side.
BLOCK, LISTED = 1 << 20, 16

_BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, pa.ArrowInvalid, NotImplementedError, RuntimeError, UnicodeDecodeError)


def located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and the path in it; Hadoop's ``file:/x`` is ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri)


@dataclass
class Member(InputPartition):
    archive: str
    name: str

    def __post_init__(self):
        self.value = self.archive


class ZippedReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: Mapping[str, str]):
        self.asked = [f.name for f in schema.fields]
        self.folder, self.columns = options["folder"].rstrip("/"), options["columns"].split(",")
        self.archives, self.members = options.get("archives", "*.zip").split("|"), options.get("members", "*.csv")

    def partitions(self) -> Sequence[Member]:
        system, root = located(self.folder)
        files = system.get_file_info(pa.fs.FileSelector(root, recursive=True, allow_not_found=True))
        below = {f.path: f.path[len(root) :].lstrip("/") for f in files if f.type == pa.fs.FileType.File}
        paths = sorted(p for p, name in below.items() if any(fnmatchcase(name, a) for a in self.archives))

        def members(path: str) -> list[Member]:
            try:
                with system.open_input_file(path) as file, zipfile.ZipFile(file) as archive:
                    return [Member(path, i.filename) for i in archive.infolist() if not i.is_dir() and fnmatchcase(i.filename, self.members)]
            except _BROKEN as e:
                raise ValueError(f"{path} is not a readable ZIP archive: {e}") from e

        with ThreadPoolExecutor(LISTED) as pool:
            return [m for found in pool.map(members, paths) for m in found] or [Member("", "")]

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        if not partition.archive:
            return
        system, _ = located(self.folder)
        wanted = [c for c in self.asked if c in self.columns]
        line = 0
        try:
            with system.open_input_file(partition.archive) as file, zipfile.ZipFile(file) as archive, archive.open(partition.name) as stream:
                first = stream.read(BLOCK)
                if not first.strip():
                    return
                reader = pa.csv.open_csv(
                    pa.PythonFile(_Chained(first, stream), mode="r"),
                    read_options=pa.csv.ReadOptions(column_names=self.columns, block_size=BLOCK, use_threads=False),
                    convert_options=pa.csv.ConvertOptions(
                        include_columns=wanted or self.columns[:1], column_types=dict.fromkeys(self.columns, pa.string()), strings_can_be_null=True, null_values=[""]
                    ),
                )
                for batch in reader:
                    made = {
                        "_file": pa.array([f"{partition.archive}!{partition.name}"] * batch.num_rows, pa.string()),
                        "_line": pa.array(range(line, line + batch.num_rows), pa.int64()),
                    }
                    line += batch.num_rows
                    yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in self.asked], self.asked)
        except _BROKEN as e:
            raise ValueError(f"{partition.archive}!{partition.name} cannot be read: {e}") from e


class _Chained:
    """What was read already, then the rest of a stream."""

    def __init__(self, first: bytes, stream):
        self.first, self.stream, self.closed = BytesIO(first), stream, False

    def read(self, n: int = -1) -> bytes:
        return self.first.read(n) or self.stream.read(n)

    def readable(self) -> bool:
        return True

    def close(self) -> None:
        self.closed = True


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv")``: options ``folder``, ``columns`` (of the files, in order), ``archives`` and ``members`` (globs, below the folder)."""

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def schema(self) -> T.StructType:
        names = self.options["columns"].split(",")
        return T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField("_file", T.StringType()), T.StructField("_line", T.LongType())])

    def reader(self, schema: T.StructType) -> ZippedReader:
        return ZippedReader(schema, self.options)


def read_zipped(
    spark: SparkSession, folder: str, columns: Sequence[str], wanted: Sequence[str], archives: str | Sequence[str] = "*.zip", members: str = "*.csv"
) -> DataFrame:
    """The ``wanted`` columns, as text, of all members of all archives, with ``_file`` and ``_line``."""
    spark.dataSource.register(ZippedCsv)
    schema = ", ".join([*[f"`{c}` string" for c in wanted], "_file string", "_line long"])
    globs = [archives] if isinstance(archives, str) else archives
    return (
        spark.read.format("zipped_csv")
        .schema(schema)
        .options(folder=folder, columns=",".join(columns), archives="|".join(globs), members=members)
        .load()
    )


def write_zipped(df: DataFrame, folder: str, keys: Sequence[str], name: str, columns: Sequence[str], order: str) -> DataFrame:
    """One archive per group of ``keys``, with one member of ``columns`` without a header; ``name`` is a format of the keys.

    A group must fit a task, as a month of bars does. Returns ``archive, rows``;
    archives are written when that is read. A repeated task writes the same file.
    """

    def write(group: pd.DataFrame) -> pd.DataFrame:
        system, root = located(folder)
        label = name.format(*[group[k].iloc[0] for k in keys])
        text = group.sort_values(order, kind="stable")[list(columns)].to_csv(index=False, header=False)
        packed = BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{label.rsplit('/', 1)[-1]}.csv", text)
        path = f"{root}/{label}.zip"
        system.create_dir(path.rsplit("/", 1)[0])
        with system.open_output_stream(path) as out:
            out.write(packed.getvalue())
        return pd.DataFrame({"archive": [path], "rows": [len(group)]})

    return df.groupBy(*keys).applyInPandas(write, "archive string, rows long")


def line_order() -> list[str]:
    return ["_file", "_line"]


def numeric_lines(df: DataFrame, column: str) -> DataFrame:
    """Without header lines: rows whose first field is a number."""
    return df.where(F.col(column).try_cast("double").isNotNull())
