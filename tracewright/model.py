"""Trace sets as DataFrames.

A trace is one row: ``trace_idx``, ``samples`` (array<float>, equal length in a set) and ``data`` (its
auxiliary bytes).  Statistics work on the long form, one row per sample; ranges and strides are
cut out of the array before it is exploded, since filters are not pushed through an explode.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE_SCHEMA = "trace_idx long, samples array<float>, data binary"
SHIFT_SCHEMA = "trace_idx long, shift int"


@dataclass(frozen=True)
class Header:
    """What a file says of its traces; ``params`` maps a name to (offset, length, type)."""

    n_traces: int = 0
    n_samples: int = 0
    sample_type: str = "float32"
    data_length: int = 0
    title: str = ""
    x_scale: float = 1.0
    y_scale: float = 1.0
    labels: tuple[str, str] = ("", "")
    params: dict[str, tuple[int, int, int]] = field(default_factory=dict)


@dataclass(frozen=True)
class TraceSet:
    """A DataFrame of traces with its header. Instances are values: every edit gives a new one, so
    the earlier ones are the undo history."""

    df: DataFrame
    header: Header = Header()
    pipeline: tuple = ()

    def set_params(self, params: dict[str, tuple[int, int, int]]) -> TraceSet:
        return replace(self, header=replace(self.header, params=dict(params)))

    def with_step(self, step, at: int | None = None) -> TraceSet:
        steps = list(self.pipeline)
        steps.insert(len(steps) if at is None else at, step)
        return replace(self, pipeline=tuple(steps))

    def without_step(self, at: int) -> TraceSet:
        return replace(self, pipeline=self.pipeline[:at] + self.pipeline[at + 1 :])

    def moved_step(self, at: int, by: int) -> TraceSet:
        steps = list(self.pipeline)
        to = min(max(at + by, 0), len(steps) - 1)
        steps.insert(to, steps.pop(at))
        return replace(self, pipeline=tuple(steps))

    def processed(self) -> DataFrame:
        out = self.df
        for step in self.pipeline:
            out = step(out)
        return out

    def close(self) -> None:
        self.df.unpersist()

    def describe(self) -> DataFrame:
        """One row: counts, type, bytes per trace, and the length after the pipeline."""
        n = self.header.n_samples
        for step in self.pipeline:
            n = step.length(n)
        h = self.header
        return self.df.sparkSession.createDataFrame([(h.n_traces, h.n_samples, h.sample_type, h.data_length, n)], "n_traces long, n_samples long, sample_type string, data_length long, processed_length long")


def from_arrays(spark: SparkSession, samples: np.ndarray, data: np.ndarray | None = None) -> TraceSet:
    """An in-memory trace set from an N x NS matrix and, optionally, N x DL bytes."""
    samples = np.asarray(samples, np.float32)
    data = np.zeros((len(samples), 0), np.uint8) if data is None else np.asarray(data, np.uint8)
    rows = [(i, x.tolist(), bytearray(d.tobytes())) for i, (x, d) in enumerate(zip(samples, data, strict=True))]
    ns = samples.shape[1] if samples.ndim == 2 else 0
    return TraceSet(spark.createDataFrame(rows, TRACE_SCHEMA), Header(len(rows), ns, "float32", data.shape[1]))


def embeddings_as_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as traces: byte 0 is (37 * index + 13) mod 256, byte 1 the label."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    data = F.unhex(F.concat(*[F.lpad(F.hex(b), 2, "0") for b in ((F.col("vec_id") * 37 + 13) % 256, F.col("label").cast("long"))]))
    return t.select(F.col("vec_id").cast("long").alias("trace_idx"), F.col("embedding").alias("samples"), data.alias("data"))


def events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in long form, a user being a trace: trace_idx, v. Values are not numbered, which
    would gather all events of a user."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(F.col("user_id").cast("long").alias("trace_idx"), F.col("value").cast("float").cast("double").alias("v"))


def events_chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """The events table as one trace in chunks: the value of event i is sample i."""
    t = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_id >= 0")
    parts = t.groupBy(F.floor(F.col("event_id") / size).cast("int").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("event_id", F.col("value").cast("float").alias("v")))).alias("x"))
    return parts.select(F.lit(0).cast("long").alias("trace_idx"), "chunk", F.transform("x", lambda e: e["v"]).alias("samples"))


def byte_at(data: Column, i: int | Column) -> Column:
    """Byte ``i`` of a binary as an int; null past its end."""
    i = F.lit(i) if isinstance(i, int) else i
    inside = (i >= 0) & (i < F.octet_length(data))
    return F.when(inside, F.conv(F.hex(F.substring(data, i + 1, F.lit(1))), 16, 10).cast("int"))


def to_long(traces: DataFrame, start: int = 0, count: int = 0, stride: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per sample of the range [start, start+count) (0: to the end), every ``stride``-th;
    indices count from 0 within the result. The range is cut before the explode."""
    cut = F.col("samples")
    if start or count:
        cut = F.slice(cut, start + 1, count if count else 2**31 - 1 - start)
    if stride > 1:
        cut = F.filter(cut, lambda _, i: i % stride == 0)
    return traces.select("trace_idx", *keep, F.posexplode(cut).alias("sample_idx", "f")).select("trace_idx", *keep, "sample_idx", F.col("f").cast("double").alias("v"))


def to_traces(long: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The long form back to one row per trace."""
    return long.groupBy("trace_idx", *keep).agg(F.sort_array(F.collect_list(F.struct("sample_idx", "v"))).alias("x")).select("trace_idx", F.transform("x", lambda e: e["v"].cast("float")).alias("samples"), *keep)
