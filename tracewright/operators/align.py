"""Alignment of traces to a reference trace: shift tables by peak or by normalised correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_peak(samples: Column, start: Column, end: Column, use_abs: bool) -> Column:
    """Index of the first largest (absolute) sample in [start, end)."""
    part = F.slice(samples, start + 1, F.greatest(F.lit(0), end - start))
    value = F.transform(part, lambda x: (F.abs(x) if use_abs else x).cast("double"))
    return start + F.array_position(value, F.array_max(value)).cast("int") - 1


def _reference(traces: DataFrame, ref: int) -> list[float]:
    found = traces.where(F.col("trace_idx") == ref).select("samples").head()
    if found is None:
        raise ValueError("the reference trace is not in the range")
    return list(found[0])


def align_by_peak(traces: DataFrame, ref: int, region: tuple[int, int], half: int, use_abs: bool = False) -> DataFrame:
    """trace_idx, shift: distance of each trace's peak near the reference peak from it. The reference
    trace, one row, is read first; its own shift is 0."""
    x = np.array(_reference(traces, ref), np.float64)
    a, b = max(0, region[0]), min(len(x), region[1])
    if b <= a:
        raise ValueError("empty reference region")
    p = a + int(np.argmax(np.abs(x[a:b]) if use_abs else x[a:b]))
    n = F.size("samples")
    peak = first_peak(F.col("samples"), F.greatest(F.lit(0), F.lit(p - half)), F.least(n, F.lit(p + half + 1)), use_abs)
    return traces.select("trace_idx", F.when(F.col("trace_idx") == ref, 0).otherwise(peak - p).cast("int").alias("shift"))


def align_by_correlation(traces: DataFrame, ref: int, region: tuple[int, int], half: int) -> DataFrame:
    """trace_idx, shift: lag of the largest normalised correlation (as float32, the lowest lag wins)
    of the reference region with each trace; windows of zero norm count 0. Traces of null samples have no shift."""
    x = np.array(_reference(traces, ref), np.float64)
    a, b = max(0, region[0]), min(len(x), region[1])
    if b - a < 2:
        raise ValueError("the reference region needs two samples")
    template = x[a:b] - x[a:b].mean()
    norm = np.sqrt((template**2).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, shifts = batch.column("trace_idx").to_pylist(), []
            for key, samples in zip(keys, batch.column("samples").to_pylist(), strict=True):
                y = np.asarray(samples, np.float64)
                lo, hi = max(0, a - half), min(len(y) - len(template), a + half)
                if key == ref or hi < lo:
                    shifts.append(0)
                    continue
                windows = np.lib.stride_tricks.sliding_window_view(y[lo : hi + len(template)], len(template))
                centred = windows - windows.mean(axis=1, keepdims=True)
                below = norm * np.sqrt((centred**2).sum(axis=1))
                score = np.where(below > 0, centred @ template / np.where(below > 0, below, 1), 0).astype(np.float32)
                shifts.append(lo + int(score.argmax()) - a)
            yield pa.RecordBatch.from_arrays([batch.column("trace_idx"), pa.array(shifts, pa.int32())], ["trace_idx", "shift"])

    return traces.select(F.col("trace_idx").cast("long").alias("trace_idx"), "samples").where("samples IS NOT NULL").mapInArrow(run, "trace_idx long, shift int")


def manual_shift(shifts: DataFrame, trace: int, delta: int) -> DataFrame:
    """The shift table after dragging one trace by delta samples."""
    return shifts.withColumn("shift", F.when(F.col("trace_idx") == trace, F.col("shift") - delta).otherwise(F.col("shift")))
