"""Sizes of image files from their headers: a ranged read of 33 bytes a file, nothing is decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsalign.sources.files import read_asset_manifest
from tsalign.sources.zipped import located

# The signature of a PNG file, and the bit depths of each colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
HEADER = 33


def png_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first bytes of a PNG file; None if they are no valid header."""
    if len(data) < HEADER or not data.startswith(SIGNATURE) or data[8:16] != b"\x00\x00\x00\rIHDR":
        return None
    width, height, depth, colour, packing, filtering, interlace, check = struct.unpack(">IIBBBBBI", data[16:HEADER])
    fine = zlib.crc32(data[12:29]) == check and 0 < width < 2**31 and 0 < height < 2**31 and depth in DEPTHS.get(colour, ())
    return (width, height) if fine and packing == filtering == 0 and interlace < 2 else None


def png_header(width: int, height: int) -> bytes:
    """The first bytes of a PNG file of 8-bit RGB."""
    head = b"IHDR" + struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return SIGNATURE + b"\x00\x00\x00\r" + head + struct.pack(">I", zlib.crc32(head))


def with_png_size(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Add ``width, height`` (NULL without a valid header) and ``bytes`` (NULL where the file cannot be opened).

    One open and one small read per file, where the manifest's rows are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(path).to_pylist():
                size, length = None, None
                if uri is not None:
                    try:
                        system, place = located(uri)
                        with system.open_input_file(place) as file:
                            length, size = file.size(), png_size(file.read(HEADER))
                    except OSError:
                        pass
                found.append((*(size or (None, None)), length))
            columns = zip(*found) if found else ((), (), ())
            made = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "width", "height", "bytes"])

    fields = ", ".join(f"`{n}` {t}" for n, t in manifest.dtypes)
    return manifest.mapInArrow(run, f"{fields}, width int, height int, bytes long")


def read_image_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """``asset, unix_ts, path, width, height, bytes`` of the PNG files below a folder."""
    return with_png_size(read_asset_manifest(spark, folder))


def image_coverage(expected: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """``expected`` with the valid image of each row, as :func:`tsalign.operators.profile.image_sample_report` takes it.

    ``path`` is NULL where there is no file or its header is not valid; ``found`` tells which.
    """
    good = F.col("width").isNotNull()
    held = sizes.select(*keys, F.when(good, F.col("path")).alias("path"), "width", "height", F.lit(True).alias("found"))
    return expected.join(held, keys, "left").withColumn("found", F.coalesce("found", F.lit(False)))
