"""NumPy files: NPY arrays and NPZ archives of traces, data and named columns, read by row ranges and written
by tasks.

An archive's directory and the heads of its arrays are read on the driver, never an array.  Stored members
are read by seeking; deflated ones have no places to seek to, so a task for each streams it into the shared
folder first.  Writers range-partition the traces; each task writes its rows of every member in one pass,
with their CRC-32s; these are joined algebraically, and the parts are copied to their places by tasks.
"""

from __future__ import annotations

import io
import json
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, InputPartition
from pyspark.sql.types import StructType

from tracewright.model import TRACE_SCHEMA, Header, TraceSet
from tracewright.sources.ranges import BATCH_BYTES, TraceSelection, Units, push_filters_on, split
from tracewright.sources.shared import Piece, crc_of, joined_crc, remove, shared_file, write_whole

#: Element types that become float samples, and those of named columns with their Spark types.
SAMPLE_TYPES = ("<f4", "<f8", "|u1", "<i2", "<i4", "<i8")
COLUMN_TYPES = {"|u1": "smallint", "|i1": "tinyint", "<u2": "int", "<i2": "smallint", "<u4": "bigint", "<i4": "int", "<u8": "decimal(20,0)", "<i8": "bigint", "<f4": "float", "<f8": "double"}
#: 2-D members beside the traces that hold their bytes.
DATA_NAMES = ("data", "labels", "textin", "plaintext")


def npy_head(f) -> tuple[tuple[int, ...], np.dtype, int]:
    """Shape, type and data offset; Fortran order is refused rather than misread."""
    version = np.lib.format.read_magic(f)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(f)
    if fortran and len(shape) > 1:
        raise ValueError("Fortran order is not supported")
    return shape, dtype, f.tell()


@dataclass(frozen=True)
class ArrayAt:
    """A C-ordered array in a file."""

    path: str
    at: int
    shape: tuple[int, ...]
    dtype: str

    @property
    def rows(self) -> tuple[int, int]:
        """Rows and elements of each; a vector is one value a row."""
        n = int(np.prod(self.shape[1:], dtype=np.int64))
        return self.shape[0], n

    def read(self, rows: list[int] | range, first: int = 0, count: int | None = None) -> np.ndarray:
        """The elements [first, first+count) of each of the rows; neighbours without a gap by one read."""
        per, size = self.rows[1], np.dtype(self.dtype).itemsize
        count = per - first if count is None else count
        out = np.empty((len(rows), count), self.dtype)
        with open(self.path, "rb", buffering=0) as f:
            k = 0
            while k < len(rows):
                end = k + 1
                while count == per and end < len(rows) and rows[end] == rows[end - 1] + 1:
                    end += 1
                f.seek(self.at + (rows[k] * per + first) * size)
                out[k:end] = np.frombuffer(f.read((end - k) * count * size), self.dtype).reshape(end - k, count)
                k = end
        return out


def npy_at(path: str) -> ArrayAt:
    with open(path, "rb") as f:
        shape, dtype, at = npy_head(f)
    return ArrayAt(path, at, shape, dtype.str)


#: How column values are handed to Spark, which has no unsigned numbers.
WIDER = {"|u1": pa.int16(), "<u2": pa.int32(), "<u4": pa.int64(), "<u8": pa.decimal128(20, 0)}


class ArrayReader(DataSourceReader):
    """Rows of traces from an array of samples, named vectors, or a matrix of bytes."""

    def __init__(self, options: dict, columns: list[str]):
        spec = json.loads(options["arrays"])
        made = lambda x: ArrayAt(x["path"], x["at"], tuple(x["shape"]), x["dtype"])
        self.traces, self.data = made(spec["traces"]), made(spec["data"]) if spec["data"] else None
        self.named = {k: made(x) for k, x in spec["named"].items()}
        self.rows, self.columns = int(options.get("rows_per_partition", "0")), columns
        n, ns = self.traces.rows
        self.first = min(ns, max(0, int(options.get("first_sample", "0"))))
        self.count = min(ns - self.first, int(options.get("n_samples", "0")) or ns)
        self.selection = TraceSelection(0, n)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        yield from self.selection.push(filters)

    @property
    def record_bytes(self) -> int:
        return self.count * np.dtype(self.traces.dtype).itemsize if "samples" in self.columns else 64

    def partitions(self) -> list[InputPartition]:
        return split(len(self.selection.traces), self.record_bytes, self.rows)

    def read(self, part: Units) -> Iterator[pa.RecordBatch]:
        traces, each = self.selection.traces, max(1, BATCH_BYTES // max(1, self.record_bytes))
        for a in range(part.first, part.last, each):
            rows = traces[a : min(part.last, a + each)]
            out: dict[str, pa.Array] = {"trace_idx": pa.array(np.array(rows, np.int64))}
            if "samples" in self.columns:
                x = self.traces.read(rows, self.first, self.count).astype(np.float32)
                out["samples"] = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * self.count), pa.array(x.ravel()))
            values = {k: v.read(rows) for k, v in self.named.items() if k in self.columns or "data" in self.columns}
            if "data" in self.columns:
                if self.named:  # every named value, little-endian, one after another
                    raw = np.concatenate([v.view(np.uint8).reshape(len(rows), -1) for v in values.values()], axis=1)
                elif self.data is not None:
                    raw = self.data.read(rows).astype(np.int64).astype(np.uint8)
                else:
                    raw = np.zeros((len(rows), 0), np.uint8)
                out["data"] = pa.array([x.tobytes() for x in raw], pa.binary())
            for k, v in values.items():
                plain = pa.array(v.ravel())
                out[k] = plain.cast(WIDER[self.named[k].dtype]) if self.named[k].dtype in WIDER else plain
            yield pa.RecordBatch.from_arrays([out[c] for c in self.columns], self.columns)


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "arrays"

    def schema(self) -> str:
        return TRACE_SCHEMA

    def reader(self, schema: StructType) -> ArrayReader:
        return ArrayReader(self.options, schema.fieldNames())


def _opened(spark: SparkSession, traces: ArrayAt, data: ArrayAt | None, named: dict[str, ArrayAt], rows_per_partition: int, first_sample: int, n_samples: int) -> DataFrame:
    spark.dataSource.register(ArraySource)
    push_filters_on(spark)
    spec = json.dumps({"traces": asdict(traces), "data": asdict(data) if data else None, "named": {k: asdict(v) for k, v in named.items()}})
    schema = ", ".join([TRACE_SCHEMA, *[f"`{k}` {COLUMN_TYPES[v.dtype]}" for k, v in named.items()]])
    reader = spark.read.format("arrays").schema(schema).option("arrays", spec)
    for k, v in (("rows_per_partition", rows_per_partition), ("first_sample", first_sample), ("n_samples", n_samples)):
        reader = reader.option(k, str(v))
    return reader.load()


def open_npy(spark: SparkSession, path: str, rows_per_partition: int = 0, first_sample: int = 0, n_samples: int = 0) -> TraceSet:
    """The rows of a float32 array as traces; a vector is one trace, further dimensions are samples."""
    found = npy_at(path)
    if found.dtype != "<f4":
        raise ValueError(f"unsupported element type {found.dtype}")
    if len(found.shape) == 1:
        found = ArrayAt(path, found.at, (1, *found.shape), found.dtype)
    return TraceSet(_opened(spark, found, None, {}, rows_per_partition, first_sample, n_samples), Header(*found.rows))


# --- archives ---------------------------------------------------------------------------------------------


def _members(path: str) -> dict[str, tuple[zipfile.ZipInfo, ArrayAt]]:
    """The arrays of an archive by name, in the order of its directory, from that and their heads alone.
    Of a deflated member the place is that of the deflated bytes."""
    out = {}
    with zipfile.ZipFile(path) as z, open(path, "rb") as f:
        for info in z.infolist():
            if not (info.filename.endswith(".npy") or info.filename == "traces"):
                continue
            if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError("only stored and deflated members are supported")
            with z.open(info) as m:
                shape, dtype, head = npy_head(m)
            f.seek(info.header_offset + 26)
            name, extra = struct.unpack("<HH", f.read(4))
            start = info.header_offset + 30 + name + extra
            at = start + head if info.compress_type == zipfile.ZIP_STORED else start
            out[info.filename.removesuffix(".npy")] = (info, ArrayAt(path, at, shape, dtype.str))
    return out


def _inflated(spark: SparkSession, wanted: dict[str, tuple[zipfile.ZipInfo, ArrayAt]]) -> dict[str, ArrayAt]:
    """The arrays in files to seek in: each deflated member is streamed into the shared folder by a task of its
    own, under a name it takes when whole. These files stay for as long as the traces are read."""
    jobs = [(k, a.path, a.at, i.compress_size, shared_file(spark, ".npy")) for k, (i, a) in wanted.items() if i.compress_type == zipfile.ZIP_DEFLATED]

    def inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part, machine, left = f"{row['to']}-{uuid.uuid4().hex}", zlib.decompressobj(-15), row["size"]
                with open(row["path"], "rb") as f, open(part, "wb") as out:
                    f.seek(row["at"])
                    while left and (raw := f.read(min(left, 1 << 20))):
                        left -= len(raw)
                        while raw:
                            out.write(machine.decompress(raw, 8 << 20))
                            raw = machine.unconsumed_tail
                    out.write(machine.flush())
                os.replace(part, row["to"])
            yield batch.select(["name"])

    if jobs:
        spark.createDataFrame(jobs, "name string, path string, at long, size long, to string").repartition(len(jobs)).mapInArrow(inflate, "name string").count()
    placed = {k: npy_at(to) for k, _, _, _, to in jobs}
    return {k: placed.get(k, a) for k, (_, a) in wanted.items()}


def open_npz(spark: SparkSession, path: str, rows_per_partition: int = 0, first_sample: int = 0, n_samples: int = 0) -> TraceSet:
    """Traces (``traces`` or the first 2-D array) with real typed columns for the named vectors of a value per
    trace. ``data`` packs the named columns, little-endian at growing offsets recorded in the header's parameters,
    and is else the 2-D data mod 256. Names of columns that a trace has already get an underscore."""
    arrays = _members(path)
    name = "traces" if "traces" in arrays else next((k for k, (_, a) in arrays.items() if len(a.shape) == 2), None)
    if name is None or len(arrays[name][1].shape) != 2 or arrays[name][1].dtype not in SAMPLE_TYPES:
        raise ValueError("no two-dimensional array of traces")
    n, ns = arrays[name][1].shape
    wanted = {k: x for k, x in arrays.items() if k != name and len(x[1].shape) == 1 and x[1].shape[0] == n and x[1].dtype in COLUMN_TYPES}
    data = None if wanted else next((k for k in DATA_NAMES if k in arrays and k != name and len(arrays[k][1].shape) == 2 and arrays[k][1].shape[0] == n), None)
    placed = _inflated(spark, {k: x for k, x in arrays.items() if k in wanted or k in (name, data)})
    params, offset, named = {}, 0, {}
    for k in wanted:
        width = np.dtype(placed[k].dtype).itemsize
        params[k] = (offset, width, 1 if width == 1 else 2)
        offset += width
        named[f"{k}_" if k in ("trace_idx", "samples", "data") else k] = placed[k]
    df = _opened(spark, placed[name], placed[data] if data else None, named, rows_per_partition, first_sample, n_samples)
    return TraceSet(df, Header(n, ns, "float32", offset or (placed[data].shape[1] if data else 0), params=params))


# --- writers ----------------------------------------------------------------------------------------------


def npy_header(shape: tuple[int, ...], dtype: str) -> bytes:
    f = io.BytesIO()
    np.lib.format.write_array_header_1_0(f, {"descr": dtype, "fortran_order": False, "shape": shape})
    return f.getvalue()


@dataclass(frozen=True)
class Array:
    """An array that tasks have written: its parts in order with their CRC-32s."""

    dtype: str
    width: int | None
    parts: list[tuple[str, int, int]]


def _written(traces: DataFrame, columns: dict[str, tuple[Column, str, bool]], path: str) -> tuple[int, dict[str, Array]]:
    """Rows and arrays of columns (expression, element type, whether a row has several), by one pass over the traces
    in index order. Part files lie beside the target; a task that is run again writes new ones."""
    token, names = uuid.uuid4().hex, list(columns)
    kinds = {"<f4": "array<float>", "|u1": "binary"}
    rows = traces.select("trace_idx", *[F.coalesce(c, F.array()).cast(kinds[t]).alias(f"c{i}") if t == "<f4" else c.cast(kinds[t] if many else "long").alias(f"c{i}") for i, (c, t, many) in enumerate(columns.values())])
    ordered = rows.repartitionByRange("trace_idx").sortWithinPartitions("trace_idx")
    shapes = [(t, many) for _, t, many in columns.values()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [f"{path}.{token}-{uuid.uuid4().hex}" for _ in shapes]
        open_files, first, count, widths, sizes, crcs = [open(f, "wb") for f in files], None, 0, [None] * len(shapes), [0] * len(shapes), [0] * len(shapes)
        for batch in batches:
            if batch.num_rows and first is None:
                first = batch.column("trace_idx")[0].as_py()
            count += batch.num_rows
            for i, (dtype, many) in enumerate(shapes):
                column = batch.column(f"c{i}")
                if dtype == "<f4":
                    at = column.offsets.to_numpy()
                    lengths, raw = np.diff(at), column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype("<f4").tobytes()
                elif many:
                    values = [bytes(v or b"") for v in column.to_pylist()]
                    lengths, raw = np.array([len(v) for v in values]), b"".join(values)
                else:
                    lengths, raw = np.zeros(0, int), column.fill_null(0).to_numpy().astype(dtype).tobytes()
                for w in np.unique(lengths).tolist():
                    if widths[i] not in (None, w):
                        raise ValueError("traces of different length in one file")
                    widths[i] = w
                open_files[i].write(raw)
                sizes[i], crcs[i] = sizes[i] + len(raw), crc_of(raw, crcs[i])
        for f in open_files:
            f.flush()
            os.fsync(f.fileno())
            f.close()
        yield pa.RecordBatch.from_pydict({"first": [first], "n": [count], "files": [files], "widths": [widths], "sizes": [sizes], "crcs": [crcs]}, schema=pa.schema([("first", pa.int64()), ("n", pa.int64()), ("files", pa.list_(pa.string())), ("widths", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("crcs", pa.list_(pa.int64()))]))

    # a few numbers for each task
    try:
        parts = sorted((r for r in ordered.mapInArrow(write, "first long, n long, files array<string>, widths array<long>, sizes array<long>, crcs array<long>").collect() if r.n), key=lambda r: r.first)
        out = {}
        for i, name in enumerate(names):
            widths = {r.widths[i] for r in parts} - {None}
            if len(widths) > 1:
                raise ValueError("traces of different length in one file")
            dtype, many = shapes[i]
            out[name] = Array(dtype, (widths.pop() if widths else 0) if many else None, [(r.files[i], r.sizes[i], r.crcs[i]) for r in parts])
    except Exception:
        remove(f"{path}.{token}-*")
        raise
    return sum(r.n for r in parts), {"token": token, **out}


def _laid_out(n: int, array: Array, at: int) -> tuple[bytes, list[Piece], int, int]:
    """Header, pieces from ``at`` on, bytes and CRC-32 of an array's file."""
    header = npy_header((n,) if array.width is None else (n, array.width), array.dtype)
    crc, size, pieces = crc_of(header), len(header), []
    for path, length, part in array.parts:
        pieces.append(Piece(path, length, at + size))
        crc, size = joined_crc(crc, part, length), size + length
    return header, pieces, size, crc


def write_traces_npy(traces: DataFrame, path: str, overwrite: bool = False) -> None:
    """One float32 array with the traces in index order, written by tasks."""
    n, arrays = _written(traces, {"traces": (F.col("samples"), "<f4", True)}, path)
    try:
        header, pieces, size, _ = _laid_out(n, arrays["traces"], 0)
        write_whole(traces.sparkSession, path, size, [(0, header)], pieces, overwrite)
    finally:
        remove(f"{path}.{arrays['token']}-*")


def write_traces_npz(traces: DataFrame, path: str, labels: dict | None = None, overwrite: bool = False) -> None:
    """An archive of stored members in index order: ``traces`` and, where traces have bytes, ``data``; with ``labels``
    (name -> column) one array of each instead. Members of any size (ZIP64), all in one pass of the traces."""
    columns = {"traces": (F.col("samples"), "<f4", True)}
    columns |= {"data": (F.col("data"), "|u1", True)} if labels is None else {k: (c, "<i8", False) for k, c in labels.items()}
    n, arrays = _written(traces, columns, path)
    try:
        at, fixed, pieces, directory, members = 0, [], [], b"", 0
        for name, array in arrays.items():
            if name == "token" or name == "data" and not array.width:
                continue
            file = f"{name}.npy".encode()
            start = at + 30 + len(file) + 20
            header, own, size, crc = _laid_out(n, array, start)
            common = struct.pack("<HHHHHLLLH", 45, 0x800, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(file))
            fixed += [(at, b"PK\3\4" + common + struct.pack("<H", 20) + file + struct.pack("<HHQQ", 1, 16, size, size)), (start, header)]
            directory += b"PK\1\2" + struct.pack("<H", 45) + common + struct.pack("<HHHHLL", 28, 0, 0, 0, 0, 0xFFFFFFFF) + file + struct.pack("<HHQQQ", 1, 24, size, size, at)
            pieces, at, members = pieces + own, start + size, members + 1
        end = b"PK\6\6" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, members, members, len(directory), at)
        end += b"PK\6\7" + struct.pack("<LQL", 0, at + len(directory), 1)
        end += b"PK\5\6" + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
        fixed.append((at, directory + end))
        write_whole(traces.sparkSession, path, at + len(directory) + len(end), fixed, pieces, overwrite)
    finally:
        remove(f"{path}.{arrays['token']}-*")


# --- small arrays on the driver ---------------------------------------------------------------------------


def read_member(archive: zipfile.ZipFile, name: str) -> np.ndarray:
    if archive.getinfo(name).compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        raise ValueError("only stored and deflated members are supported")
    f = io.BytesIO(archive.read(name))
    shape, dtype, at = npy_head(f)
    return np.frombuffer(f.getbuffer()[at:], dtype, int(np.prod(shape, dtype=np.int64))).reshape(shape)


def to_matrix(traces: DataFrame) -> np.ndarray:
    """Traces in index order as one float32 matrix, row by row through the driver: NumPy files are
    single files, as large as the driver's disk allows."""
    return np.array([np.asarray(r[0], "<f4") for r in traces.orderBy("trace_idx").select("samples").toLocalIterator()], "<f4")


def write_npy(array: np.ndarray, path: str) -> None:
    np.save(path, np.ascontiguousarray(array), allow_pickle=False)


def write_npz(arrays: dict[str, np.ndarray], path: str) -> None:
    """An uncompressed archive of the arrays."""
    np.savez(path, **arrays)


def vector_to_array(vector: DataFrame, column: str, dtype: str = "<f4") -> np.ndarray:
    return np.array([r[0] for r in vector.orderBy("sample_idx").select(column).collect()], dtype)


def write_tstat_npz(tstats: DataFrame, path: str) -> None:
    write_npz({"tstat": vector_to_array(tstats, "t"), "df": vector_to_array(tstats, "df", "<f8")}, path)


def read_tstat(spark: SparkSession, path: str) -> DataFrame:
    """sample_idx, t and, if the archive has it, df."""
    if path.endswith(".npz"):
        with zipfile.ZipFile(path) as z:
            t = read_member(z, "tstat.npy")
            df = read_member(z, "df.npy") if "df.npy" in z.namelist() else None
    else:
        t, df = np.load(path), None
    if t.ndim != 1:
        raise ValueError("not a vector")
    columns = {"sample_idx": np.arange(len(t), dtype=np.int32), "t": t.astype(np.float64)} | ({"df": df.astype(np.float64)} if df is not None else {})
    return spark.createDataFrame(pa.table(columns))


def matrix_to_array(matrix: DataFrame, row: str, column: str, value: str, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape, "<f4")
    for r in matrix.select(row, column, value).toLocalIterator():
        out[r[0], r[1]] = r[2]
    return out


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """i, j, corr of a square matrix file."""
    a = np.load(path)
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("not a square matrix")
    i, j = np.indices(a.shape)
    return spark.createDataFrame(pa.table({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "corr": a.ravel().astype(np.float64)}))


def open_traces(spark: SparkSession, path: str) -> TraceSet:
    """Opens a trace file by its extension."""
    from tracewright.sources.trs import open_trs

    kind = path.rsplit(".", 1)[-1].lower()
    return {"npy": open_npy, "npz": open_npz}.get(kind, open_trs)(spark, path)
