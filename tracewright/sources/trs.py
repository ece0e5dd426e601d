"""TRS trace files: a Python data source that reads ranges by seeking, and a writer.

A file is a list of (tag, length, value) objects up to the trace block, then fixed-size records
[title][data][samples].  Read options: ``path``, ``rows_per_partition``, ``first_sample`` and
``n_samples`` (the sample range that is read), ``chunk_samples`` (reads chunks of traces, see ``operators.chunks``).
Filters on trace_idx become seeks, and columns that the schema leaves out are not read.
"""

from __future__ import annotations

import glob
import io
import os
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tracewright.model import TRACE_SCHEMA, Header, TraceSet
from tracewright.sources.ranges import BATCH_BYTES, TraceSelection, Units, push_filters_on, split

# Tags of the file format.
TAG_TRACES, TAG_SAMPLES, TAG_CODING, TAG_DATA, TAG_TITLE_SPACE = 0x41, 0x42, 0x43, 0x44, 0x45
TAG_TITLE, TAG_DESCRIPTION, TAG_X_LABEL, TAG_Y_LABEL, TAG_X_SCALE, TAG_Y_SCALE = 0x46, 0x47, 0x49, 0x4A, 0x4B, 0x4C
TAG_PARAMETERS, TAG_BLOCK = 0x77, 0x5F
CODINGS = {0x01: ("int8", "<i1"), 0x02: ("int16", "<i2"), 0x12: ("int16", "<i2"), 0x04: ("int32", "<i4"), 0x14: ("float32", "<f4")}


@dataclass(frozen=True)
class Layout:
    header: Header
    start: int
    title: int
    sample_bytes: int
    dtype: str

    @property
    def stride(self) -> int:
        return self.title + self.header.data_length + self.header.n_samples * self.sample_bytes


def parse_parameters(value: bytes) -> dict[str, tuple[int, int, int]]:
    """name -> (offset, length, type); ends quietly where the map is cut off."""
    out, at = {}, 2
    for _ in range(int.from_bytes(value[:2], "little")):
        n = int.from_bytes(value[at : at + 2], "little")
        if at + 2 + n + 5 > len(value):
            break
        name = value[at + 2 : at + 2 + n].decode("utf-8", "replace")
        kind, length, offset = struct.unpack_from("<BHH", value, at + 2 + n)
        out[name] = (offset, length, kind)
        at += 2 + n + 5
    return out


def parse_header(raw: bytes) -> Layout:
    """The layout that a file's first bytes describe."""
    return parse_objects(io.BytesIO(raw), len(raw))


#: Tags whose values are needed.
KNOWN = {TAG_TRACES, TAG_SAMPLES, TAG_CODING, TAG_DATA, TAG_TITLE_SPACE, TAG_TITLE, TAG_X_LABEL, TAG_Y_LABEL, TAG_X_SCALE, TAG_Y_SCALE, TAG_PARAMETERS}


def parse_objects(f: io.BufferedIOBase, size: int) -> Layout:
    """Reads objects one after another up to the trace block; values that are not needed are passed over."""
    if not size:
        raise ValueError("empty file")
    at, seen = 0, {}
    while True:
        if at + 2 > size:
            raise ValueError("no trace block (tag 0x5F)")
        tag, length = f.read(2)
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > size:
                raise ValueError("bad length")
            length = int.from_bytes(f.read(n), "little")
            at += n
        if tag == TAG_BLOCK:
            break
        if at + length > size:
            raise ValueError("truncated object")
        if tag in KNOWN:
            seen[tag] = f.read(length)
        else:
            f.seek(at + length)
        at += length
    number = lambda tag, default=0: int.from_bytes(seen[tag], "little") if tag in seen else default
    real = lambda tag: struct.unpack("<f", seen[tag][:4])[0] if len(seen.get(tag, b"")) >= 4 else 1.0
    text = lambda tag: seen.get(tag, b"").decode("utf-8", "replace")
    coding = number(TAG_CODING, 0x01)
    kind, dtype = CODINGS.get(coding & 0x1F, ("int8", "<i1"))
    size = (coding & 0x0F) or 1
    header = Header(number(TAG_TRACES), number(TAG_SAMPLES), kind, number(TAG_DATA), text(TAG_TITLE), real(TAG_X_SCALE), real(TAG_Y_SCALE), (text(TAG_X_LABEL), text(TAG_Y_LABEL)), parse_parameters(seen.get(TAG_PARAMETERS, b"")))
    if header.n_samples <= 0:
        raise ValueError("no samples")
    layout = Layout(header, at, number(TAG_TITLE_SPACE), size, dtype)
    if layout.stride <= 0:
        raise ValueError("empty traces")
    return layout


def read_layout(path: str) -> Layout:
    """The layout of a file, whatever the size of its header; nothing behind the header is read."""
    with open(path, "rb") as f:
        return parse_objects(f, os.path.getsize(path))


def decode_samples(raw: bytes, layout: Layout) -> np.ndarray:
    """float32 samples; of a coding with an unusual width the first byte of each sample counts."""
    if layout.sample_bytes == np.dtype(layout.dtype).itemsize:
        return np.frombuffer(raw, layout.dtype).astype(np.float32)
    return np.frombuffer(raw, "i1").reshape(-1, layout.sample_bytes)[:, 0].astype(np.float32)


class TrsReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.rows, self.columns = options["path"], int(options.get("rows_per_partition", "0")), columns
        self.layout = la = read_layout(self.path)
        ns = la.header.n_samples
        self.first = min(ns, max(0, int(options.get("first_sample", "0"))))
        self.count = min(ns - self.first, int(options.get("n_samples", "0")) or ns)
        self.chunk = int(options.get("chunk_samples", "0"))
        # a file cut short holds fewer records than its header says
        whole = max(0, os.path.getsize(self.path) - la.start) // la.stride
        self.selection = TraceSelection(0, min(la.header.n_traces, whole))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  the interface's name
        yield from self.selection.push(filters)

    @property
    def per_trace(self) -> int:
        return -(-self.count // self.chunk) if self.chunk else 1

    @property
    def record_bytes(self) -> int:
        """Bytes that a unit takes from the file."""
        samples = min(self.chunk or self.count, self.count) * self.layout.sample_bytes if "samples" in self.columns else 0
        return samples + (self.layout.header.data_length if "data" in self.columns else 0)

    def partitions(self) -> list[InputPartition]:
        return split(len(self.selection.traces) * self.per_trace, self.record_bytes, self.rows)

    def read(self, partition: Units) -> Iterator[pa.RecordBatch]:
        la, traces, per = self.layout, self.selection.traces, self.per_trace
        dl, each = la.header.data_length, max(1, BATCH_BYTES // max(1, self.record_bytes))
        with open(self.path, "rb", buffering=0) as f:

            def at(place: int, n: int) -> bytes:
                f.seek(place)
                raw = b""
                while len(raw) < n and (more := f.read(n - len(raw))):
                    raw += more
                return raw

            whole = not self.chunk and self.first == 0 and self.count == la.header.n_samples and {"samples", "data"} <= set(self.columns)
            for a in range(partition.first, partition.last, each):
                units = [(traces[u // per], u % per) for u in range(a, min(partition.last, a + each))]
                out: dict[str, pa.Array] = {"trace_idx": pa.array([t for t, _ in units], pa.int64()), "chunk": pa.array([c for _, c in units], pa.int32())}
                starts = [la.start + t * la.stride + la.title for t, _ in units]
                block = at(starts[0], starts[-1] - starts[0] + la.stride - la.title) if whole and starts[-1] - starts[0] == (len(units) - 1) * la.stride else None
                get = (lambda place, n: block[place - starts[0] : place - starts[0] + n]) if block is not None else at  # noqa: B023
                if "data" in self.columns:
                    out["data"] = pa.array([get(s, dl) if c == 0 else None for s, (_, c) in zip(starts, units, strict=True)], pa.binary())
                if "samples" in self.columns:
                    parts = []
                    for s, (_, c) in zip(starts, units, strict=True):
                        first = self.first + c * self.chunk
                        n = min(self.chunk, self.first + self.count - first) if self.chunk else self.count
                        parts.append(decode_samples(get(s + dl + first * la.sample_bytes, n * la.sample_bytes), la))
                    bounds = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
                    out["samples"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([out[c] for c in self.columns], self.columns)


def _object(tag: int, value: bytes) -> bytes:
    n = len(value)
    head = bytes([n]) if n < 0x80 else bytes([0x84]) + struct.pack("<I", n)
    return bytes([tag]) + head + value


def header_bytes(n_traces: int, n_samples: int, data_length: int = 0) -> bytes:
    """A float32 header of counts, coding and, if any, data length."""
    return _object(TAG_TRACES, struct.pack("<I", n_traces)) + _object(TAG_SAMPLES, struct.pack("<I", n_samples)) + _object(TAG_CODING, b"\x14") + (_object(TAG_DATA, struct.pack("<H", data_length)) if data_length else b"") + bytes([TAG_BLOCK, 0])


@dataclass
class Part(WriterCommitMessage):
    """A task's records: ``ends`` has the samples of its first and last trace, which other parts may
    continue, ``inner`` the (samples, data bytes) that all traces between have."""

    path: str
    order: tuple[int, int]
    heads: int
    ends: list[tuple[int, int, int]]
    inner: tuple[int, int] | None


class TrsWriter(DataSourceArrowWriter):
    """Tasks write record files beside the target, in trace order within each; the commit writes the
    header and appends the parts by their first trace, streaming, to a file that takes the target's
    name when it is whole; parts of failed attempts go as well. Input must be range-partitioned
    by trace_idx, and by chunk where there are chunks (``write_trs`` and ``write_trs_chunks`` do that): a chunk of -1 brings
    a trace's data. An existing target is refused unless it is to be overwritten. The target must be in a
    folder that all executors share."""

    def __init__(self, options: dict, columns: list[str], overwrite: bool):
        self.path, self.columns = options["path"], columns
        self.token = options.get("token") or uuid.uuid4().hex
        self.overwrite = overwrite
        self._refuse()

    def _refuse(self) -> None:
        if not self.overwrite and os.path.exists(self.path):
            raise FileExistsError(f"{self.path} is there already")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        name, order, heads, traces, same = f"{self.path}.{self.token}-{uuid.uuid4().hex}", None, 0, [], None
        chunked = "chunk" in self.columns
        with open(name, "wb") as f:
            for batch in batches:
                chunks = batch.column("chunk").to_pylist() if chunked else [-1] * batch.num_rows
                lists = batch.column("samples")
                bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<f4")
                for i, (key, chunk, data) in enumerate(zip(batch.column("trace_idx").to_pylist(), chunks, batch.column("data").to_pylist(), strict=True)):
                    x, d = values[bounds[i] : bounds[i + 1]], bytes(data or b"")
                    order = order or (key, chunk)
                    heads += chunk == -1
                    if traces and traces[-1][0] == key and chunked:
                        traces[-1] = (key, traces[-1][1] + len(x), traces[-1][2] + len(d))
                    else:
                        if len(traces) > 2:
                            same = self._one(same, traces.pop(1)[1:])
                        traces.append((key, len(x), len(d)))
                    f.write(d + x.tobytes())
        for t in traces[1:-1]:
            same = self._one(same, t[1:])
        return Part(name, order or (0, 0), heads, [traces[0], traces[-1]] if len(traces) > 1 else traces, same)

    @staticmethod
    def _one(known: tuple[int, int] | None, found: tuple[int, int]) -> tuple[int, int]:
        if known is not None and known != found:
            raise ValueError("traces of different length in one file")
        return found

    def commit(self, messages: list) -> None:
        self._refuse()
        parts, same, now = sorted((m for m in messages if m and m.ends), key=lambda m: m.order), None, None
        for p in parts:
            if p.inner is not None:
                same = self._one(same, p.inner)
            for key, ns, dl in p.ends:
                if now is not None and now[0] == key and "chunk" in self.columns:
                    now = (key, now[1] + ns, now[2] + dl)
                    continue
                if now is not None:
                    same = self._one(same, now[1:])
                now = (key, ns, dl)
        if now is not None:
            same = self._one(same, now[1:])
        ns, dl = same or (0, 0)
        whole = f"{self.path}.{self.token}-whole"
        with open(whole, "wb") as f:
            f.write(header_bytes(sum(p.heads for p in parts), ns, dl))
            for p in parts:
                with open(p.path, "rb") as g:
                    while chunk := g.read(8 << 20):
                        f.write(chunk)
            f.flush()
            os.fsync(f.fileno())
        os.replace(whole, self.path)
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for name in glob.glob(f"{glob.escape(self.path)}.{self.token}-*"):
            os.remove(name)


class TrsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "trs"

    def schema(self) -> str:
        return CHUNK_SCHEMA if int(self.options.get("chunk_samples", "0")) else TRACE_SCHEMA

    def reader(self, schema: StructType) -> TrsReader:
        return TrsReader(self.options, schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> TrsWriter:
        return TrsWriter(self.options, schema.fieldNames(), overwrite)


CHUNK_SCHEMA = "trace_idx long, chunk int, samples array<float>"


def _reader(spark: SparkSession, path: str, rows_per_partition: int, first_sample: int, n_samples: int):
    spark.dataSource.register(TrsSource)
    push_filters_on(spark)
    return spark.read.format("trs").option("path", path).option("rows_per_partition", str(rows_per_partition)).option("first_sample", str(first_sample)).option("n_samples", str(n_samples))


def open_trs(spark: SparkSession, path: str, rows_per_partition: int = 0, first_sample: int = 0, n_samples: int = 0, columns: tuple[str, ...] = ("trace_idx", "samples", "data")) -> TraceSet:
    """The traces of a file; of each the samples of a range (0: to the end), and only the named columns."""
    kinds = dict(c.split(" ") for c in TRACE_SCHEMA.split(", "))
    reader = _reader(spark, path, rows_per_partition, first_sample, n_samples)
    return TraceSet(reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(), read_layout(path).header)


def open_trs_chunks(spark: SparkSession, path: str, chunk_samples: int, rows_per_partition: int = 0, first_sample: int = 0, n_samples: int = 0) -> DataFrame:
    """The samples of a file as chunks (trace_idx, chunk, samples) of ``chunk_samples``, the last of a trace
    shorter; many tasks may read one trace."""
    return _reader(spark, path, rows_per_partition, first_sample, n_samples).option("chunk_samples", str(chunk_samples)).load()


def write_trs(traces: DataFrame, path: str, overwrite: bool = False) -> None:
    """One float32 file with the traces in index order. Null samples are a trace without samples."""
    traces.sparkSession.dataSource.register(TrsSource)
    ordered = traces.select("trace_idx", F.coalesce("samples", F.array().cast("array<float>")).cast("array<float>").alias("samples"), "data").repartitionByRange("trace_idx").sortWithinPartitions("trace_idx")
    ordered.write.format("trs").option("path", path).mode("overwrite" if overwrite else "append").save()


def write_trs_chunks(chunks: DataFrame, path: str, data: DataFrame | None = None, overwrite: bool = False) -> None:
    """As ``write_trs`` from chunks (trace_idx, chunk, samples) and, where there are any, the bytes of each trace
    (trace_idx, data): no task holds a whole trace."""
    chunks.sparkSession.dataSource.register(TrsSource)
    none = F.lit(None).cast("binary")
    heads = (chunks.where("chunk = 0").withColumn("data", none) if data is None else data).select(F.col("trace_idx").cast("long").alias("trace_idx"), F.lit(-1).alias("chunk"), F.array().cast("array<float>").alias("samples"), "data")
    rows = chunks.select(F.col("trace_idx").cast("long").alias("trace_idx"), "chunk", "samples", none.alias("data")).unionByName(heads)
    ordered = rows.repartitionByRange("trace_idx", "chunk").sortWithinPartitions("trace_idx", "chunk")
    ordered.write.format("trs").option("path", path).mode("overwrite" if overwrite else "append").save()


def write_vector_trs(vector: DataFrame, value: str, path: str, overwrite: bool = False) -> None:
    """A result by sample (t statistic, say) as a file of one trace."""
    rows = vector.select(F.lit(0).alias("i"), F.col("sample_idx").alias("j"), F.col(value).alias("v"))
    write_matrix_trs(rows, "i", "j", "v", path, overwrite)


def write_matrix_trs(matrix: DataFrame, row: str, column: str, value: str, path: str, overwrite: bool = False) -> None:
    """A matrix as a file with a trace for each row, its samples in column order."""
    gathered = matrix.groupBy(F.col(row).cast("long").alias("trace_idx")).agg(F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), F.col(value).alias("v")))).alias("x"))
    write_trs(gathered.select("trace_idx", F.transform("x", lambda e: e["v"].cast("float")).alias("samples"), F.lit(b"").alias("data")), path, overwrite)
