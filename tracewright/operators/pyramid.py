"""Extremes of long traces at every zoom, from a stored table of block extremes.

The pyramid has a row for each block of ``base`` samples, of ``base x factor``, and so on up to a whole trace:
trace_idx, level, block, lo, hi.  A view of any stretch of the traces in ``width`` pixels takes for each pixel the
largest blocks that lie within it, smaller ones towards its edges, and samples only in the last part of
a block at either edge: per pixel a few blocks of each level and less than two base blocks of samples,
however long the stretch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE, FACTOR = 256, 4
PYRAMID = "trace_idx long, level int, block long, lo double, hi double"


def block_size(level: int, base: int = BASE, factor: int = FACTOR) -> int:
    return base * factor**level


def build(chunks: DataFrame, size: int, n_samples: int, base: int = BASE, factor: int = FACTOR) -> DataFrame:
    """The pyramid of chunks of ``size`` samples, a multiple of ``base``, up to blocks that hold ``n_samples``. Blocks
    within chunks are made where the chunks are; those above come from a row per chunk."""
    if size % base:
        raise ValueError("chunks must hold whole base blocks")
    inner = [0]
    while size % block_size(inner[-1] + 1, base, factor) == 0:
        inner.append(inner[-1] + 1)
    top = inner[-1]
    while block_size(top, base, factor) < n_samples:
        top += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("samples")
            bounds, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (t, c) in enumerate(zip(batch.column("trace_idx").to_pylist(), batch.column("chunk").to_pylist(), strict=True)):
                lo = hi = values[bounds[i] : bounds[i + 1]].astype(np.float64)
                for level in inner:
                    at = np.arange(0, len(lo), factor if level else base)
                    if len(at):
                        lo, hi = np.fmin.reduceat(lo, at), np.fmax.reduceat(hi, at)
                        first = c * (size // block_size(level, base, factor))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), t, np.int64)), pa.array(np.full(len(lo), level, np.int32)), pa.array(first + np.arange(len(lo), dtype=np.int64)), pa.array(lo), pa.array(hi)], ["trace_idx", "level", "block", "lo", "hi"])

    low = chunks.select(F.col("trace_idx").cast("long").alias("trace_idx"), F.col("chunk").cast("int").alias("chunk"), "samples").mapInArrow(run, PYRAMID)
    if top == inner[-1]:
        return low
    up = low.where(F.col("level") == inner[-1]).withColumn("to", F.explode(F.sequence(F.lit(inner[-1] + 1), F.lit(top))))
    block = F.floor(F.col("block") / F.pow(F.lit(factor), F.col("to") - F.col("level"))).cast("long")
    return low.unionByName(up.groupBy("trace_idx", F.col("to").alias("level"), block.alias("block")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))


def save(pyramid: DataFrame, path: str) -> None:
    """A folder for each level, sorted, so that a view reads the row groups it needs."""
    pyramid.repartitionByRange("level", "trace_idx", "block").sortWithinPartitions("level", "trace_idx", "block").write.partitionBy("level").parquet(path)


@dataclass(frozen=True)
class Cover:
    """What a view needs: blocks (level, block, pixel) and stretches of samples (start, end, pixel)."""

    blocks: np.ndarray
    stretches: np.ndarray


def cover(start: int, length: int, width: int, base: int = BASE, factor: int = FACTOR) -> Cover:
    """The largest blocks within each pixel of a view, and the samples at its edges."""
    pixels = np.arange(width + 1, dtype=np.int64)
    edges = start + -(-pixels * length // width)
    at = np.stack([edges[:-1], edges[1:], pixels[:-1]], axis=1)
    at, level = at[at[:, 1] > at[:, 0]], 0
    while block_size(level + 1, base, factor) * width <= length:
        level += 1
    found = []
    for k in range(level, -1, -1):
        size = block_size(k, base, factor)
        a, b = -(-at[:, 0] // size), at[:, 1] // size
        whole = a < b
        n = (b - a)[whole]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found.append(np.stack([np.full(n.sum(), k), np.repeat(a[whole], n) + inside, np.repeat(at[whole, 2], n)], axis=1))
        left = np.stack([at[whole, 0], a[whole] * size, at[whole, 2]], axis=1)
        right = np.stack([b[whole] * size, at[whole, 1], at[whole, 2]], axis=1)
        at = np.concatenate([at[~whole], left, right])
        at = at[at[:, 1] > at[:, 0]]
    return Cover(np.concatenate(found), at)


def view(pyramid: DataFrame, chunks: DataFrame, size: int, start: int, length: int, width: int, base: int = BASE, factor: int = FACTOR) -> DataFrame:
    """trace_idx, pixel, lo, hi of a view of every trace, as ``display.pixel_extremes`` gives them from all its samples.
    What is read grows with the width, not with the length: the wanted blocks, some of each level a pixel, are
    broadcast, and the levels and chunks they lie in are picked before the join."""
    spark, need = pyramid.sparkSession, cover(start, length, width, base, factor)
    parts = None
    for level in np.unique(need.blocks[:, 0]).tolist():
        own = need.blocks[need.blocks[:, 0] == level]
        wanted = spark.createDataFrame(pa.table({"block": own[:, 1], "pixel": own[:, 2].astype(np.int32)}))
        rows = pyramid.where((F.col("level") == level) & F.col("block").between(int(own[:, 1].min()), int(own[:, 1].max())))
        rows = rows.join(F.broadcast(wanted), "block").select("trace_idx", "pixel", "lo", "hi")
        parts = rows if parts is None else parts.unionByName(rows)
    if len(need.stretches):
        a, b, pixel = need.stretches.T
        n = (b - 1) // size - a // size + 1
        row = np.repeat(np.arange(len(a)), n)
        chunk = a[row] // size + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first, last = np.maximum(a[row], chunk * size) - chunk * size, np.minimum(b[row], (chunk + 1) * size) - chunk * size
        wanted = spark.createDataFrame(pa.table({"chunk": chunk.astype(np.int32), "first": first.astype(np.int32), "n": (last - first).astype(np.int32), "pixel": pixel[row].astype(np.int32)}))
        rows = chunks.where(F.col("chunk").between(int(chunk.min()), int(chunk.max()))).join(F.broadcast(wanted), "chunk")
        cut = rows.select("trace_idx", "pixel", F.slice("samples", F.col("first") + 1, F.col("n")).alias("x")).where(F.size("x") > 0)
        rows = cut.select("trace_idx", "pixel", F.array_min("x").cast("double").alias("lo"), F.array_max("x").cast("double").alias("hi"))
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        return spark.createDataFrame([], "trace_idx long, pixel int, lo double, hi double")
    return parts.groupBy("trace_idx", "pixel").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
