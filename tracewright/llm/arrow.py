"""Feeding Arrow batches to numpy kernels in pieces of bounded text size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tracewright.llm.common import give_back_memory

#: Bytes of text that a kernel sees at once; a single longer text is a piece of its own. Kernels need
#: up to a hundred bytes of working memory for each byte of text.
PIECE_BYTES = 512 << 10

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def pieces(batch: pa.RecordBatch, text: str = "text", limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in its text column, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield batch.slice(start)


def trimmed(run: Run) -> Run:
    """The same, returning freed memory when a task ends: the worker stays alive for later tasks, and
    beside stages that need no Python."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back_memory()

    return wrapped


def map_pieces(df: DataFrame, kernel: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: str = "text") -> DataFrame:
    """``mapInArrow`` with a kernel that is called once per piece; it may return None for no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, text):
                out = kernel(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(trimmed(run), schema)
