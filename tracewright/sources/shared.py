"""A folder that driver and executors share, and files that tasks fill together."""

from __future__ import annotations

import glob
import os
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes that a task copies at once.
COPY_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The local path of the folder in ``spark.checkpoint.dir``; where that is unset and all tasks run on this
    machine, a temporary folder, which is then set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = re.sub(r"^file:(//)?", "", found)
    if "://" in path:
        raise ValueError("files of this format need a mounted shared folder")
    os.makedirs(path, exist_ok=True)
    return path


def shared_file(spark: SparkSession, ending: str) -> str:
    """A new name in that folder."""
    return os.path.join(shared_folder(spark), f"{uuid.uuid4().hex}{ending}")


# --- CRC-32 of joined pieces ------------------------------------------------------------------------------

POLYNOMIAL = 0xEDB88320  # of CRC-32, lowest power in the highest bit


def _product(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC's."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two pieces laid end to end, from theirs and the second's length: the first's is
    multiplied by x to the power of the second's bits."""
    factor, square, n = 1 << 31, 1 << 23, length  # x^0 and x^8
    while n:
        if n & 1:
            factor = _product(factor, square)
        square, n = _product(square, square), n >> 1
    return _product(factor, first) ^ second


# --- files filled by tasks --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Piece:
    """Bytes of a part file and where they belong in the whole."""

    path: str
    size: int
    at: int


def write_whole(spark: SparkSession, path: str, size: int, fixed: list[tuple[int, bytes]], pieces: list[Piece], overwrite: bool) -> None:
    """A file of ``size`` bytes under a name that it takes when it is whole: the driver writes the ``fixed``
    pieces, tasks copy the part files to their places. A task that is run again writes the same bytes again."""
    if not overwrite and os.path.exists(path):
        raise FileExistsError(f"{path} is there already")
    whole = f"{path}.{uuid.uuid4().hex}-whole"
    with open(whole, "wb") as f:
        f.truncate(size)
        for at, raw in fixed:
            f.seek(at)
            f.write(raw)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(whole, "r+b") as out:
                for row in batch.to_pylist():
                    out.seek(row["at"])
                    with open(row["path"], "rb") as f:
                        while chunk := f.read(COPY_BYTES):
                            out.write(chunk)
                out.flush()
                os.fsync(out.fileno())
            yield batch.select(["at"])

    if pieces:
        rows = spark.createDataFrame([(p.path, p.size, p.at) for p in pieces], "path string, size long, at long")
        rows.repartition(len(pieces)).mapInArrow(copy, "at long").count()
    os.replace(whole, path)


def remove(pattern: str) -> None:
    for name in glob.glob(pattern):
        os.remove(name)


def crc_of(raw: bytes, crc: int = 0) -> int:
    return zlib.crc32(raw, crc)
