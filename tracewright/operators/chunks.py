"""Traces as chunks, for traces too long for one row: read, transformed and written by many tasks.

The chunk form has a row for each run of ``size`` samples of a trace: trace_idx, chunk (counted from 0; the last
of a trace may be shorter), samples.  A transform of chunks equals the transform of whole rows:

* what looks at one sample, or at blocks of samples, runs where the chunk is; outputs and sums of blocks that
  chunks share are sent to the chunk of the result that they belong to;
* what looks at samples further off has the stretch of them sent to the chunk (halo exchange), which is
  no more than another chunk's length for a moving average of any width;
* what depends on all samples before, or on the whole trace, has it carried by a small table of one row
  for each chunk: sums before the chunk, and the trace's mean and deviation.

So a task holds a chunk and its halo, whatever the length of the trace.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.transforms import Transform, noise_values, one_sided

#: Samples of a chunk where none is named: 1 MB.
CHUNK = 1 << 18


def to_chunks(traces: DataFrame, size: int = CHUNK) -> DataFrame:
    """Rows of whole traces as chunks; null and empty traces have none."""
    starts = F.sequence(F.lit(0), F.size("samples") - 1, F.lit(size))
    cut = F.transform(starts, lambda s: F.struct((s / size).cast("int").alias("chunk"), F.slice("samples", s + 1, F.lit(size)).alias("samples")))
    rows = traces.where(F.size("samples") > 0).select(F.col("trace_idx").cast("long").alias("trace_idx"), F.explode(cut).alias("c"))
    return rows.select("trace_idx", "c.chunk", F.col("c.samples").cast("array<float>").alias("samples"))


def to_rows(chunks: DataFrame) -> DataFrame:
    """Chunks as rows of whole traces, for traces that fit one."""
    parts = F.sort_array(F.collect_list(F.struct("chunk", "samples")))
    return chunks.groupBy("trace_idx").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


def to_long(chunks: DataFrame, size: int) -> DataFrame:
    """One row per sample: trace_idx, sample_idx, v."""
    rows = chunks.select("trace_idx", "chunk", F.posexplode("samples").alias("i", "f"))
    return rows.select("trace_idx", (F.col("chunk").cast("long") * size + F.col("i")).alias("sample_idx"), F.col("f").cast("double").alias("v"))


def sample_range(chunks: DataFrame, size: int, start: int, count: int) -> DataFrame:
    """Samples [start, start+count) as chunks that begin at start: only chunks that hold some are touched."""
    first = F.col("chunk").cast("long") * size
    touched = chunks.where((first < start + count) & (first + size > start))
    runs = touched.select("trace_idx", F.greatest(first, F.lit(start)).alias("a"), first.alias("first"), "samples")
    cut = F.slice("samples", (F.col("a") - F.col("first") + 1).cast("int"), F.greatest(F.lit(0), F.least(F.lit(start + count), F.col("first") + size) - F.col("a")).cast("int"))
    return _assembled(runs.select("trace_idx", (F.col("a") - start).alias("at"), F.lit(0).alias("n"), cut.cast("array<double>").alias("samples")), size)


# --- the exchange -----------------------------------------------------------------------------------------

OWN, PIECE = 1, 2
MESSAGE = "trace_idx long, chunk int, kind int, at long, samples array<float>, carried array<double>"


def _messages(df: DataFrame, chunk: Column, kind: int, at: Column | int = 0, samples: Column | None = None, carried: Column | None = None) -> DataFrame:
    return df.select("trace_idx", chunk.cast("int").alias("chunk"), F.lit(kind).alias("kind"), (F.lit(at) if isinstance(at, int) else at).cast("long").alias("at"), (F.array() if samples is None else samples).cast("array<float>").alias("samples"), (F.array() if carried is None else carried).cast("array<double>").alias("carried"))


def _pieces(chunks: DataFrame, size: int, offset: int, length: int) -> DataFrame:
    """Every chunk k gets the samples [k size + offset, k size + offset + length) of its trace, as far as there are
    any outside the chunk itself."""
    first = F.col("chunk").cast("long") * size
    low = F.ceil((first - offset - length + 1) / F.lit(size)).cast("int")
    high = F.floor((first + F.size("samples") - 1 - offset) / F.lit(size)).cast("int")
    targets = F.filter(F.sequence(F.greatest(low, F.lit(0)), high), lambda k: k != F.col("chunk"))
    sent = chunks.where((high >= 0) & (high >= low)).select("*", F.explode(targets).alias("to"))
    start = F.greatest(F.lit(0), F.col("to").cast("long") * size + offset - first)
    stop = F.least(F.size("samples").cast("long"), F.col("to").cast("long") * size + offset + length - first)
    return _messages(sent, F.col("to"), PIECE, first + start, F.slice("samples", (start + 1).cast("int"), (stop - start).cast("int")))


Kernel = Callable[[int, np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[int, int, np.ndarray]]]


def _exchanged(chunks: DataFrame, size: int, kernel: Kernel, halo: tuple[int, int] | None = None, carried: DataFrame | None = None) -> DataFrame:
    """Runs of output (trace_idx, at, n, samples): what ``kernel(start, own, pieces, carried)`` yields for each
    chunk, as (at, n, samples), the pieces in the order of their places; n tells sums of n samples from finished samples (0)."""
    sent = _messages(chunks, F.col("chunk"), OWN, samples=F.col("samples"))
    if halo is not None:
        sent = sent.unionByName(_pieces(chunks, size, *halo))
    if carried is not None:
        sent = sent.unionByName(carried)
    if halo is not None or carried is not None:
        sent = sent.repartition("trace_idx", "chunk").sortWithinPartitions("trace_idx", "chunk", "kind", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, pieces, more = None, None, [], np.zeros(0)

        def made() -> Iterator[pa.RecordBatch]:
            if own is None:
                return
            found = list(kernel(key[1] * size, own, np.concatenate([np.zeros(0), *pieces]), more))
            bounds = np.concatenate([[0], np.cumsum([len(x) for _, _, x in found])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([np.zeros(0), *(x for _, _, x in found)])))
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([a for a, _, _ in found], pa.int64()), pa.array([n for _, n, _ in found], pa.int32()), values], ["trace_idx", "at", "n", "samples"])

        for batch in batches:
            lists, carries = batch.column("samples"), batch.column("carried")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (t, c, kind) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("trace_idx", "chunk", "kind")), strict=True)):
                if (t, c) != key:
                    yield from made()
                    key, own, pieces, more = (t, c), None, [], np.zeros(0)
                x = values[bounds[i] : bounds[i + 1]].astype(np.float64)
                if kind == OWN:
                    own = x
                elif kind == PIECE:
                    pieces.append(x)
                else:
                    more = np.array(carries[i].as_py(), np.float64)
        yield from made()

    return sent.mapInArrow(run, "trace_idx long, at long, n int, samples array<double>")


def _assembled(runs: DataFrame, size: int, block: int = 0) -> DataFrame:
    """Runs of output as chunks: each run is cut at the bounds of chunks and sent to them; sums of one sample
    are added up and count once they hold ``block`` samples."""
    length = F.size("samples")
    low, high = (F.floor(x / F.lit(size)).cast("int") for x in (F.col("at"), F.col("at") + length - 1))
    cut = runs.where(length > 0).select("*", F.explode(F.sequence(low, high)).alias("chunk"))
    first = F.greatest(F.col("at"), F.col("chunk").cast("long") * size)
    stop = F.least(F.col("at") + length, (F.col("chunk").cast("long") + 1) * size)
    parts = cut.select("trace_idx", "chunk", first.alias("at"), "n", F.slice("samples", (first - F.col("at") + 1).cast("int"), (stop - first).cast("int")).alias("samples"))
    ordered = parts.repartition("trace_idx", "chunk").sortWithinPartitions("trace_idx", "chunk", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, at_sum, count, total = None, [], None, 0, 0.0

        def made() -> Iterator[pa.RecordBatch]:
            out = np.concatenate([np.zeros(0), *held]).astype(np.float32)
            if key is not None and len(out):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))], ["trace_idx", "chunk", "samples"])

        for batch in batches:
            lists = batch.column("samples")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (t, c, at, n) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("trace_idx", "chunk", "at", "n")), strict=True)):
                if (t, c) != key:
                    yield from made()
                    key, held, at_sum = (t, c), [], None
                x = values[bounds[i] : bounds[i + 1]]
                if not n:
                    held.append(x)
                    continue
                if at != at_sum:
                    at_sum, count, total = at, 0, 0.0
                count, total = count + n, total + x[0]
                if count == block:
                    held.append(np.array([total / count]))
        yield from made()

    return ordered.mapInArrow(run, "trace_idx long, chunk int, samples array<float>")


# --- carried tables ---------------------------------------------------------------------------------------


def chunk_sums(chunks: DataFrame, head: int = 0) -> DataFrame:
    """One row for each chunk: n, mean and m2 (around it), and the sum of the first ``head`` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            rows = [values[a:b].astype(np.float64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            means = [x.mean() for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("trace_idx"), batch.column("chunk"), pa.array([len(x) for x in rows], pa.int64()), pa.array(means), pa.array([((x - m) ** 2).sum() for x, m in zip(rows, means, strict=True)]), pa.array([float(x[:head].sum()) for x in rows])], ["trace_idx", "chunk", "n", "mean", "m2", "head"])

    return chunks.select(F.col("trace_idx").cast("long").alias("trace_idx"), F.col("chunk").cast("int").alias("chunk"), "samples").mapInArrow(run, "trace_idx long, chunk int, n long, mean double, m2 double, head double")


def _with_moments(sums: DataFrame) -> DataFrame:
    """Adds each trace's mean and deviation, and the sum of centred samples before each chunk."""
    whole = Window.partitionBy("trace_idx")
    before = whole.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    out = sums.withColumn("all_n", F.sum("n").over(whole)).withColumn("all_mean", F.sum(F.col("n") * F.col("mean")).over(whole) / F.col("all_n"))
    apart = F.col("mean") - F.col("all_mean")
    out = out.withColumn("sd", F.sqrt(F.sum(F.col("m2") + F.col("n") * apart * apart).over(whole) / F.col("all_n")))
    return out.withColumn("before", F.coalesce(F.sum(F.col("n") * apart).over(before), F.lit(0.0)))


# --- transforms -------------------------------------------------------------------------------------------


def pointwise(chunks: DataFrame, step: Transform) -> DataFrame:
    """A transform of single samples, applied to chunks as it is to rows."""
    return step(chunks)


def moving_average(chunks: DataFrame, size: int, w: int) -> DataFrame:
    """Causal mean of the last w samples, from carried sums and the stretch of samples that leaves the window:
    as many as the chunk has, w back."""
    back = -(-w // size)  # the chunk where that stretch begins
    sums = _with_moments(chunk_sums(chunks, head=back * size - w))
    order = Window.partitionBy("trace_idx").orderBy("chunk")
    left = F.lag("before", back).over(order) + F.lag("head", back).over(order) - (back * size - w) * F.col("all_mean")
    carried = _messages(sums, F.col("chunk"), 0, carried=F.array("all_mean", "before", F.coalesce(left, F.lit(0.0))))

    def kernel(start: int, own: np.ndarray, pieces: np.ndarray, more: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        mean, before, left = more
        centred = own - mean
        # the samples start - w to start + len(own) - w - 1 that there are
        stretch = np.concatenate([pieces - mean, centred])[: max(0, min(len(own), start + len(own) - w))]
        out = before + np.cumsum(centred)
        gone = (left if start > w else 0.0) + np.cumsum(stretch)
        out[len(own) - len(stretch) :] -= gone
        yield start, 0, out / np.minimum(np.arange(start + 1, start + len(own) + 1), w) + mean

    return _assembled(_exchanged(chunks, size, kernel, (-w, size), carried), size)


def window_resample(chunks: DataFrame, size: int, w: int) -> DataFrame:
    """Means of disjoint blocks of w; an incomplete last block is dropped. Blocks across chunks are sums."""

    def kernel(start: int, own: np.ndarray, *_: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        head = min(len(own), -start % w)
        if head:
            yield start // w, head, own[:head].sum(keepdims=True)
        blocks = (len(own) - head) // w
        if blocks:
            yield (start + head) // w, 0, own[head : head + blocks * w].reshape(blocks, w).mean(axis=1)
        rest = own[head + blocks * w :]
        if len(rest):
            yield (start + head) // w + blocks, len(rest), rest.sum(keepdims=True)

    return _assembled(_exchanged(chunks, size, kernel), size, w)


def stride_resample(chunks: DataFrame, size: int, k: int) -> DataFrame:
    def kernel(start: int, own: np.ndarray, *_: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        yield -(-start // k), 0, own[-start % k :: k]

    return _assembled(_exchanged(chunks, size, kernel), size)


def stft_magnitude(chunks: DataFrame, size: int, frame: int, hop: int, window: str = "hann") -> DataFrame:
    """One-sided spectra of the frames that begin in each chunk, whose ends are sent to it."""
    bins = frame // 2 + 1

    def kernel(start: int, own: np.ndarray, pieces: np.ndarray, _: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        x, first = np.concatenate([own, pieces]), -start % hop
        begins = np.arange(first, min(len(own), len(x) - frame + 1), hop)
        if len(begins):
            yield (start + first) // hop * bins, 0, one_sided(x[begins[:, None] + np.arange(frame)], window).ravel()

    return _assembled(_exchanged(chunks, size, kernel, (size, frame - 1) if frame > 1 else None), size)


def gaussian_noise(chunks: DataFrame, size: int, factor: float, seed: int) -> DataFrame:
    """As the transform of rows with that seed: noise depends on the trace and the sample's place alone."""
    sums = _with_moments(chunk_sums(chunks))
    carried = _messages(sums, F.col("chunk"), 0, carried=F.array("sd", F.col("trace_idx").cast("double")))

    def kernel(start: int, own: np.ndarray, _: np.ndarray, more: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        yield start, 0, own + factor * max(more[0], 1e-8) * noise_values(seed, int(more[1]), start, len(own))

    return _assembled(_exchanged(chunks, size, kernel, carried=carried), size) if factor > 0 else chunks


def run_pipeline(chunks: DataFrame, size: int, steps: list[Transform]) -> DataFrame:
    """The pipeline of ``steps`` on chunks; a step that needs whole traces (a spectrum of all samples) is an error."""
    for step in steps:
        if step.on_chunks is None:
            raise ValueError(f"{step.name} needs whole traces")
        name, *args = step.on_chunks
        chunks = pointwise(chunks, step) if name == "pointwise" else globals()[name](chunks, size, *args)
    return chunks
