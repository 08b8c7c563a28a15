"""Grey images written as PNG files by tasks, and read through Spark's image source."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .folders import qualified

#: Fixed values of the file format: its first bytes.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Small files that a task reads.
FILES = 256


def png(x: np.ndarray) -> bytes:
    """A grey image (rows x columns of bytes) as a PNG file."""
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = x.shape
    lines = b"".join(b"\0" + row.tobytes() for row in np.ascontiguousarray(x, dtype=np.uint8))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_drawn(rows: DataFrame, path: str, draw) -> DataFrame:
    """Writes a file for each picture to a folder that all share; (name, bytes) of each, when run.

    ``draw`` makes (name, picture or None) of an Arrow batch of ``rows``, one at a time, so a task holds one picture however many rows it has.
    A file is written under its attempt's name and renamed, so a task that runs again leaves the same files.  A row without a picture is an empty file.
    """
    path = qualified(rows.sparkSession, path)

    def run(batches):
        fs, folder = pafs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for b in batches:
            names, sizes = [], []
            for name, picture in draw(b):
                data = b"" if picture is None else png(picture)
                with fs.open_output_stream(f"{folder}/_{attempt}-{name}") as f:
                    f.write(data)
                fs.move(f"{folder}/_{attempt}-{name}", f"{folder}/{name}")
                names.append(name), sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(names, type=pa.string()), pa.array(sizes, type=pa.int64())], names=["name", "bytes"])

    return rows.mapInArrow(run, "name string, bytes long")


def write_images(images: DataFrame, path: str) -> DataFrame:
    """:func:`write_drawn` of rows of (name, width, pixels: binary, row by row); a row without pixels is an empty file."""

    def draw(b):
        for i in range(b.num_rows):
            name, width, pixels = (b.column(c)[i].as_py() for c in range(3))
            yield name, np.frombuffer(pixels, dtype=np.uint8).reshape(-1, width) if pixels else None

    return write_drawn(images.select("name", "width", "pixels"), path, draw)


def read_images(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Spark's image rows (image: origin, height, width, nChannels, mode, data) of a folder's PNG files; files that are no image are left out.

    Spark deals a few small files to a task.  Where their number is known, a task reads :data:`FILES` of them, or fewer if there are cores to spare.
    """
    found = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "[!_]*.png").load(path)
    return found if files is None else found.coalesce(max(2 * spark.sparkContext.defaultParallelism, -(-files // FILES)))
