"""Matrices as packed tiles, and products of samples summed over traces.

A tile is a row: (bi, bj), the block of rows and of columns, with their sides, and a binary of doubles.  Moment
tiles hold what is needed to add two of them: number of traces, means and squared deviations of both
blocks, and the products of centred samples (``n``, ``body``).  Each task reads its traces once and sends one row for
each tile, so a shuffle carries tiles x 8 bytes x cells for each task; tiles of one place are added in two levels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Side of a tile, and of the panels whose moments a task holds at once (128 MB of doubles).
SIDE, PANEL = 512, 4096
#: First-level groups of the tiles of one place.
GROUPS = 16
TILE = "bi int, bj int, ni int, nj int, n long, body binary"
FIELDS = ["bi", "bj", "ni", "nj", "n", "body"]


def dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of samples as a matrix; shorter ones are filled with zeros, longer ones cut, null ones left out."""
    column = column.filter(pc.is_valid(column)) if column.null_count else column
    bounds, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(bounds)
    if len(lengths) and (lengths == width).all():
        return values[bounds[0] : bounds[-1]].reshape(-1, width).astype(np.float64)
    out = np.zeros((len(lengths), width))
    for i, (a, n) in enumerate(zip(bounds[:-1].tolist(), np.minimum(lengths, width).tolist(), strict=True)):
        out[i, :n] = values[a : a + n]
    return out


class Moments:
    """Mergeable moments of the columns of two matrices that have their rows in common."""

    def __init__(self, m: int, k: int):
        self.n, self.mx, self.my, self.vx, self.vy, self.c = 0, np.zeros(m), np.zeros(k), np.zeros(m), np.zeros(k), np.zeros((m, k))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        if len(x):
            mx, my = x.mean(axis=0), y.mean(axis=0)
            x, y = x - mx, y - my
            self.merge(len(x), mx, my, (x * x).sum(axis=0), (y * y).sum(axis=0), x.T @ y)

    def merge(self, n: int, mx: np.ndarray, my: np.ndarray, vx: np.ndarray, vy: np.ndarray, c: np.ndarray) -> None:
        total = self.n + n
        dx, dy, share = mx - self.mx, my - self.my, self.n * n / total
        self.vx += vx + share * dx * dx
        self.vy += vy + share * dy * dy
        self.c += c
        if share:
            self.c += share * np.outer(dx, dy)
        self.mx, self.my, self.n = self.mx + dx * (n / total), self.my + dy * (n / total), total

    def tiles(self, i0: int, j0: int, upper: bool, side: int) -> Iterator[tuple]:
        """Rows of TILE; blocks are counted from i0 and j0; with ``upper`` only those on or over the diagonal."""
        m, k = self.c.shape
        for a in range(0, m, side):
            for b in range(0, k, side):
                bi, bj, i, j = i0 + a // side, j0 + b // side, slice(a, a + side), slice(b, b + side)
                if not upper or bi <= bj:
                    body = np.concatenate([self.mx[i], self.my[j], self.vx[i], self.vy[j], self.c[i, j].ravel()])
                    yield bi, bj, len(self.mx[i]), len(self.my[j]), self.n, body.tobytes()


def unpacked(ni: int, nj: int, body: bytes) -> tuple[np.ndarray, ...]:
    """Means and squared deviations of both blocks, and the products, of a moment tile."""
    x = np.frombuffer(body)
    mx, my, vx, vy, c = np.split(x, np.cumsum([ni, nj, ni, nj]))
    return mx, my, vx, vy, c.reshape(ni, nj)


def tile_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 4 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], FIELDS)


def moment_tiles(traces: DataFrame, first: tuple[int, int], second: tuple[int, int] | None = None, stride: int = 1, side: int = SIDE, panel: int = PANEL) -> DataFrame:
    """Moment tiles between the samples of two ranges (start, count), every ``stride``-th, or of one range with
    itself (tiles on and over the diagonal). ``panel`` is a multiple of ``side``. Missing samples are 0, traces of null samples are left out.

    Where both sides fit a panel, tasks work on their traces as they are; else each trace is sent, cut to two
    panels, to the tasks of each pair of panels: the traces are scanned once in either case."""
    same, second = second is None, second or first
    m, k = (-(-r[1] // stride) for r in (first, second))
    panels = lambda n: [(a, min(panel, n - a)) for a in range(0, n, panel)]
    pairs = [(p, q) for p in range(len(panels(m))) for q in range(len(panels(k))) if not same or p <= q]
    cut = lambda r, a, n: F.slice("samples", F.lit(r[0] + 1) + a * stride, n)
    thin = lambda c: c if stride == 1 else F.filter(c, lambda _, i: i % stride == 0)
    known = traces.where(F.col("samples").isNotNull())
    if len(pairs) == 1:
        rows = known.select(F.lit(0).alias("p"), F.lit(0).alias("q"), thin(cut(first, F.lit(0), F.lit(first[1]))).alias("x"), *([] if same else [thin(cut(second, F.lit(0), F.lit(second[1]))).alias("y")]))
    else:
        part = lambda r, c: thin(cut(r, F.col(c) * panel, F.least(F.lit(panel * stride), F.lit(r[1]) - F.col(c) * panel * stride)))
        each = known.withColumn("at", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in pairs]))).select("samples", "at.*", F.spark_partition_id().alias("salt"))
        rows = each.select("p", "q", "salt", part(first, "p").alias("x"), part(second, "q").alias("y"))
        rows = rows.repartition("p", "q", "salt").sortWithinPartitions("p", "q").drop("salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None

        def made() -> Iterator[pa.RecordBatch]:
            if sums is not None and sums.n:
                for row in sums.tiles(key[0] * (panel // side), key[1] * (panel // side), same, side):
                    yield tile_batch([row])

        for batch in batches:
            at = np.array([batch.column("p").to_numpy(), batch.column("q").to_numpy()]).T
            for i, n in zip(*runs(at), strict=True):
                now = tuple(at[i].tolist())
                if now != key:
                    yield from made()
                    key, sums = now, Moments(panels(m)[now[0]][1], panels(k)[now[1]][1])
                own = batch.slice(i, n)
                x = dense(own.column("x"), len(sums.mx))
                sums.add(x, dense(own.column("y"), len(sums.my)) if "y" in own.schema.names else x)
        yield from made()

    return added(rows.mapInArrow(run, TILE))


def runs(keys: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and lengths of runs of equal rows."""
    if not len(keys):
        return [], []
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    return starts.tolist(), np.diff(starts, append=len(keys)).tolist()


def added(tiles: DataFrame) -> DataFrame:
    """Moment tiles of one place merged into one, in two levels; tasks hold one sum at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, None
        for batch in batches:
            for row in batch.select(FIELDS).to_pylist():
                if (row["bi"], row["bj"]) != key:
                    if sums is not None:
                        yield tile_batch([(*key, len(sums.mx), len(sums.my), sums.n, _body(sums))])
                    key, sums = (row["bi"], row["bj"]), Moments(row["ni"], row["nj"])
                sums.merge(row["n"], *unpacked(row["ni"], row["nj"], row["body"]))
        if sums is not None:
            yield tile_batch([(*key, len(sums.mx), len(sums.my), sums.n, _body(sums))])

    level = tiles.withColumn("part", F.spark_partition_id() % GROUPS).repartition("bi", "bj", "part").sortWithinPartitions("bi", "bj").mapInArrow(run, TILE)
    return level.repartition("bi", "bj").sortWithinPartitions("bi", "bj").mapInArrow(run, TILE)


def _body(s: Moments) -> bytes:
    return np.concatenate([s.mx, s.my, s.vx, s.vy, s.c.ravel()]).tobytes()


def correlations(mx: np.ndarray, my: np.ndarray, vx: np.ndarray, vy: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Correlations of a moment tile; 0 where a variance is not above 1e-30, or deviations are below 1e-12 of the mean:
    that is rounding, since float32 samples cannot differ by so little."""
    good = (vx > n * np.maximum(1e-30, 1e-24 * mx * mx))[:, None] & (vy > n * np.maximum(1e-30, 1e-24 * my * my))[None, :]
    return np.where(good, c / np.sqrt(np.where(good, vx[:, None] * vy[None, :], 1.0)), 0.0)


def cells(i: np.ndarray, j: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """The cells of a block with its row and column numbers: i, j, corr."""
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(i, len(j)).astype(np.int32)), pa.array(np.tile(j, len(i)).astype(np.int32)), pa.array(values.ravel())], ["i", "j", "corr"])


def correlation_cells(tiles: DataFrame, mirrored: bool, side: int = SIDE) -> DataFrame:
    """i, j, corr of moment tiles; ``mirrored`` adds the cells below the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                r = correlations(*unpacked(row["ni"], row["nj"], row["body"]), row["n"])
                i, j = row["bi"] * side + np.arange(row["ni"]), row["bj"] * side + np.arange(row["nj"])
                yield cells(i, j, r)
                if mirrored and row["bi"] != row["bj"]:
                    yield cells(j, i, r.T)

    return tiles.mapInArrow(run, "i int, j int, corr double")
