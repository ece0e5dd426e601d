"""Signal transforms: each maps traces to traces and knows its output length.

Point-wise transforms, windows and resampling are array expressions on the row, so they need no
shuffle; spectra run as numpy kernels over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Transform:
    """A named trace transform with a static output length and a count of start-up samples; ``on_chunks`` names
    the function of ``operators.chunks`` that does the same to chunks, and its arguments."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    length: Callable[[int], int] = lambda n: n
    startup: int = 0
    on_chunks: tuple | None = None

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def _pointwise(name: str, f: Callable[[Column], Column]) -> Transform:
    return Transform(name, lambda df: df.withColumn("samples", F.transform("samples", lambda x: f(x).cast("float"))), on_chunks=("pointwise",))


def absolute() -> Transform:
    return _pointwise("Absolute value", F.abs)


def negate() -> Transform:
    return _pointwise("Negate", lambda x: -x)


def offset(c: float) -> Transform:
    return _pointwise(f"Offset {c:g}", lambda x: x + F.lit(c).cast("float"))


def scale(c: float) -> Transform:
    return _pointwise(f"Scale {c:g}", lambda x: x * F.lit(c).cast("float"))


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)


def moving_average(w: int) -> Transform:
    """Causal mean of the last w samples; at the start of those seen so far."""
    if w < 1:
        raise ValueError("window must be 1 at least")

    def f(x: np.ndarray) -> np.ndarray:
        mean = x.mean(axis=1, keepdims=True)  # sums of centred samples stay small
        sums = np.cumsum(x - mean, axis=1)
        sums[:, w:] -= sums[:, :-w].copy()
        return sums / np.minimum(np.arange(1, x.shape[1] + 1), w) + mean

    return Transform(f"Moving average {w}", lambda df: _kernel(df, f), startup=w - 1, on_chunks=("moving_average", w))


def window_resample(w: int) -> Transform:
    """Means of disjoint blocks of w; an incomplete last block is dropped."""

    def apply(df: DataFrame) -> DataFrame:
        blocks = F.floor(F.size("samples") / F.lit(w)).cast("int")
        made = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: _mean(F.slice("samples", b * w + 1, F.lit(w))).cast("float"))
        return df.withColumn("samples", F.when(blocks > 0, made).otherwise(F.array().cast("array<float>")))

    return Transform(f"Window resample {w}", apply, lambda n: n // w, on_chunks=("window_resample", w))


def stride_resample(k: int) -> Transform:
    return Transform(f"Stride resample {k}", lambda df: df.withColumn("samples", F.filter("samples", lambda _, i: i % k == 0)), lambda n: -(-n // k), on_chunks=("stride_resample", k))


def window_values(kind: str, n: int) -> np.ndarray:
    x = 2 * np.pi * np.arange(n) / max(1, n - 1)
    return {"rect": np.ones(n), "hann": 0.5 - 0.5 * np.cos(x), "hamming": 0.54 - 0.46 * np.cos(x), "blackman": 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x)}[kind]


def one_sided(frames: np.ndarray, kind: str) -> np.ndarray:
    """Windowed one-sided magnitude of rows, divided by their length, inner bins doubled."""
    n = frames.shape[1]
    out = np.abs(np.fft.rfft(frames * window_values(kind, n), axis=1)) / n
    out[:, 1:-1] *= 2
    return out


#: Samples that a kernel sees at once; a single longer trace is a part of its own.
KERNEL_SAMPLES = 1 << 17


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``KERNEL_SAMPLES`` samples, or one row."""
    bounds, start = batch.column("samples").offsets.to_numpy(), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(bounds, bounds[start] + KERNEL_SAMPLES, "right")) - 1)
        end = batch.num_rows if bounds[-1] - bounds[start] <= KERNEL_SAMPLES else end
        yield batch.slice(start, end - start)
        start = end


def _kernel(df: DataFrame, f: Callable[..., np.ndarray], key: str | None = None) -> DataFrame:
    """Replaces samples by a row-wise numpy kernel, ``KERNEL_SAMPLES`` samples of an Arrow batch at a time; rows of one
    length go through together. With ``key`` the kernel also gets that column's values of the rows. Null samples stay null."""
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_parts, batches)):
            lists = batch.column("samples")
            starts = lists.offsets.to_numpy()
            values, starts = lists.values[starts[0] : starts[-1]].to_numpy(zero_copy_only=False).astype(np.float64), starts - starts[0]
            lengths = np.diff(starts)
            out: list[np.ndarray] = [np.zeros(0)] * len(lengths)
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                more = () if key is None else ([batch.column(key)[r].as_py() for r in rows.tolist()],)
                made = f(values[starts[rows][:, None] + np.arange(n)], *more) if n else np.zeros((len(rows), 0))
                for r, x in zip(rows, made, strict=True):
                    out[r] = x
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0), *out]).astype(np.float32)
            none = pc.is_null(lists)
            made = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat), mask=none if none.true_count else None)
            arrays = [made if c == "samples" else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return df.mapInArrow(run, df.withColumn("samples", F.col("samples").cast("array<float>")).schema)


def fft_magnitude(window: str = "rect") -> Transform:
    """One-sided spectrum; traces of fewer than two samples stay as they are."""
    return Transform(f"FFT magnitude {window}", lambda df: _kernel(df, lambda x: one_sided(x, window) if x.shape[1] >= 2 else x), lambda n: n // 2 + 1 if n >= 2 else n)


def stft_magnitude(size: int, hop: int, window: str = "hann") -> Transform:
    """One-sided spectra of overlapping frames, frame after frame; too short traces give nothing."""

    def f(x: np.ndarray) -> np.ndarray:
        if x.shape[1] < size:
            return np.zeros((len(x), 0))
        frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::hop]
        return one_sided(frames.reshape(-1, size), window).reshape(len(x), -1)

    return Transform(f"STFT magnitude {size}/{hop} {window}", lambda df: _kernel(df, f), lambda n: ((n - size) // hop + 1) * (size // 2 + 1) if n >= size else 0, on_chunks=("stft_magnitude", size, hop, window))


#: Samples whose noise one generator makes.
NOISE_BLOCK = 4096


def noise_values(seed: int, trace: int | None, start: int, count: int) -> np.ndarray:
    """Normal noise of the samples [start, start+count) of a trace: a generator for each block of samples, so it
    depends neither on how traces are dealt out nor on how they are cut. A block is made as far as it is asked for: a
    view of a whole block would keep it in memory."""
    first, last = start // NOISE_BLOCK, -(-(start + count) // NOISE_BLOCK)
    end = start + count
    made = [np.random.default_rng([abs(seed), abs(trace or 0), int(trace is None), b]).standard_normal(min(NOISE_BLOCK, end - b * NOISE_BLOCK)) for b in range(first, last)]
    return np.concatenate([np.zeros(0), *made])[start - first * NOISE_BLOCK :]


def gaussian_noise(factor: float, seed: int | None = None) -> Transform:
    """Adds normal noise of ``factor`` times the trace's population deviation (floored at 1e-8). With a seed a
    trace's noise depends on the seed, the trace index and the sample's place alone."""

    base = seed if seed is not None else int(np.random.default_rng().integers(1 << 62))

    def f(x: np.ndarray, indices: list[int | None]) -> np.ndarray:
        noise = np.stack([noise_values(base, i, 0, x.shape[1]) for i in indices])
        return x + factor * np.maximum(x.std(axis=1, keepdims=True), 1e-8) * noise

    def apply(df: DataFrame) -> DataFrame:
        return _kernel(df, f, "trace_idx") if factor > 0 else df

    return Transform(f"Gaussian noise {factor:g}", apply, on_chunks=("gaussian_noise", factor, base))


def custom(name: str, apply: Callable[[DataFrame], DataFrame], length: Callable[[int], int] = lambda n: n) -> Transform:
    """A user's own transform."""
    return Transform(name, apply, length)


def run_pipeline(df: DataFrame, steps: list[Transform]) -> DataFrame:
    for step in steps:
        df = step(df)
    return df


def pipeline_length(steps: list[Transform], n: int) -> int:
    """Output length; a pipeline that leaves nothing is an error before any job runs."""
    for step in steps:
        n = step.length(n)
    if n <= 0:
        raise ValueError("the pipeline leaves no samples")
    return n
