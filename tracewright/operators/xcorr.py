"""Sample-by-sample correlation.

Products are summed over traces in packed tiles (``operators.tiles``), merged with their means, so one scan
is enough and nothing is lost to large offsets.  The eigenproblem of the cleaned matrix is solved by products
of the matrix with blocks of vectors; neither the matrix nor a Gram matrix of traces is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.projections import prepared
from tracewright.operators.tiles import SIDE, cells, correlation_cells, correlations, dense, moment_tiles, unpacked
from tracewright.operators.transforms import pipeline_length


def sample_moments(long: DataFrame) -> DataFrame:
    """sample_idx, n, mean, var (population), second pass on centred values."""
    means = long.groupBy("sample_idx").agg(F.avg("v").alias("mean"))
    centred = long.join(F.broadcast(means), "sample_idx")  # one row per sample
    d = F.col("v") - F.col("mean")
    return centred.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.first("mean").alias("mean"), F.avg(d * d).alias("var"))


def rectangle(traces: DataFrame, first: tuple[int, int], second: tuple[int, int], stride: int = 1) -> DataFrame:
    """Correlation of the samples of two ranges (start, count), every ``stride``-th: i, j, corr, indices from 0
    in each. Missing samples are 0."""
    return correlation_cells(moment_tiles(traces, first, second, stride), False)


def correlation(traces: DataFrame, n_samples: int, stride: int = 1, start: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """Full symmetric matrix i, j, corr; rows and columns of variance below 1e-30 are 0, diagonal included. Range, shifts
    and pipeline as in ``projections.prepared``; the stride comes after them."""
    length = pipeline_length(list(pipeline), n_samples)
    if -(-length // stride) < 2:
        raise ValueError("two samples at least after the stride")
    return correlation_cells(moment_tiles(prepared(traces, start, n_samples, shifts, pipeline), (0, length), None, stride), True)


def correlation_dual(traces: DataFrame, n_samples: int, stride: int = 1) -> DataFrame:
    """The same matrix as ``correlation``: with all components kept, the way over the traces' Gram matrix is
    an identity. It pays where components are dropped: ``correlation_cleaned`` takes it by itself."""
    return correlation(traces, n_samples, stride)


# --- Marchenko-Pastur cleaning ----------------------------------------------------------------------------

#: Vectors of a block, and relative residual at which a component is settled.
BLOCK, TOLERANCE = 16, 1e-10


def leading_components(product: Callable[[np.ndarray], np.ndarray], m: int, limit: float, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues above ``limit`` and their vectors of a symmetric m x m matrix that is known by its products with
    blocks of vectors: block Krylov iteration with full orthogonalization. It ends when all values above
    the limit are settled and the next one below it is too, or when the space is whole. The driver holds the
    basis, m x (block x products)."""
    rng = np.random.default_rng(0)
    basis, images = np.zeros((m, 0)), np.zeros((m, 0))
    fresh = rng.standard_normal((m, min(block, m)))
    while True:
        for _ in range(2):  # twice is enough for orthogonality
            fresh = fresh - basis @ (basis.T @ fresh)
            fresh, r = np.linalg.qr(fresh)
        fresh = fresh[:, np.abs(np.diag(r)) > 1e-8][:, : m - basis.shape[1]]
        if fresh.shape[1]:
            basis, images = np.hstack([basis, fresh]), np.hstack([images, product(fresh)])
        small = basis.T @ images
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1], vectors[:, ::-1]
        residual = np.linalg.norm(images @ vectors - basis @ vectors * values, axis=0) / max(values[0], 1e-300)
        above = int((values > limit).sum())
        whole = basis.shape[1] == m or not fresh.shape[1]
        if whole or (above < len(values) and (residual[:above] < TOLERANCE).all() and values[above] + residual[above] * values[0] < limit):
            return values[:above], basis @ vectors[:, :above]
        fresh = images[:, -fresh.shape[1] :]


def _by_tiles(tiles: DataFrame, m: int) -> Callable[[np.ndarray], np.ndarray]:
    """Products with the correlation matrix of moment tiles: each tile meets its stretch of the vectors."""

    def product(v: np.ndarray) -> np.ndarray:
        sent = tiles.sparkSession.sparkContext.broadcast(v)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    r, bi, bj = correlations(*unpacked(row["ni"], row["nj"], row["body"]), row["n"]), row["bi"], row["bj"]
                    sums[bi] = sums.get(bi, 0) + r @ sent.value[bj * SIDE : bj * SIDE + row["nj"]]
                    if bi != bj:
                        sums[bj] = sums.get(bj, 0) + r.T @ sent.value[bi * SIDE : bi * SIDE + row["ni"]]
            for b, x in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["b", "body"])

        out = np.zeros_like(v)
        for r in tiles.mapInArrow(run, "b int, body binary").toLocalIterator():  # m x block doubles of each task
            x = np.frombuffer(r.body).reshape(-1, v.shape[1])
            out[r.b * SIDE : r.b * SIDE + len(x)] += x
        sent.unpersist()
        return out

    return product


def _by_traces(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The same products without any tile, for fewer traces than samples: standardized traces meet the vectors, and
    are added up with the results as weights."""

    def product(v: np.ndarray) -> np.ndarray:
        sent = rows.sparkSession.sparkContext.broadcast((mean, scale, v))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centre, by, w = sent.value
            total = np.zeros_like(w)
            for batch in batches:
                z = (dense(batch.column("x"), len(centre)) - centre) * by
                total += z.T @ (z @ w)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["body"])

        out = sum((np.frombuffer(r.body).reshape(v.shape) for r in rows.mapInArrow(run, "body binary").toLocalIterator()), np.zeros_like(v))
        sent.unpersist()
        return out / n

    return product


def _moments(rows: DataFrame, m: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Traces, mean and population variance of every sample, as one packed row of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m2 = 0, np.zeros(m), np.zeros(m)
        for batch in batches:
            x = dense(batch.column("x"), m)
            if len(x):
                own = x.mean(axis=0)
                d = own - mean
                m2 += ((x - own) ** 2).sum(axis=0) + d * d * (n * len(x) / (n + len(x)))
                mean, n = mean + d * (len(x) / (n + len(x))), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([mean.tobytes()], pa.binary()), pa.array([m2.tobytes()], pa.binary())], ["n", "mean", "m2"])

    n, mean, m2 = 0, np.zeros(m), np.zeros(m)
    for r in rows.mapInArrow(run, "n long, mean binary, m2 binary").toLocalIterator():
        if r.n:
            d = np.frombuffer(r["mean"]) - mean
            m2 = m2 + np.frombuffer(r.m2) + d * d * (n * r.n / (n + r.n))
            mean, n = mean + d * (r.n / (n + r.n)), n + r.n
    return n, mean, m2 / max(n, 1)


def correlation_cleaned(traces: DataFrame, n_samples: int, stride: int = 1) -> tuple[DataFrame, dict]:
    """Marchenko-Pastur cleaning: the components of the correlation matrix whose eigenvalue, scaled
    by traces over samples, exceeds (1 + sqrt(traces / samples))^2. Gives the matrix i, j, corr and
    lambda_plus, n_signal.

    Products with the matrix come from its tiles, or, where there are fewer traces than samples (the dual route),
    from the traces themselves. The driver holds vectors of m samples; the cells of the result are made by tasks."""
    spark, m = traces.sparkSession, -(-n_samples // stride)
    cut = F.slice("samples", 1, n_samples)
    rows = traces.where(F.col("samples").isNotNull()).select((cut if stride == 1 else F.filter(cut, lambda _, i: i % stride == 0)).alias("x"))
    n = rows.count()
    limit = (1 + np.sqrt(n / m)) ** 2
    if not n:
        return spark.createDataFrame([], "i int, j int, corr double"), {"lambda_plus": float(limit), "n_signal": 0}
    held = (rows if n < m else moment_tiles(traces, (0, n_samples), None, stride)).persist()
    try:
        if n < m:
            _, mean, var = _moments(held, m)
            product = _by_traces(held, mean, np.where(var > 1e-30, 1 / np.sqrt(np.where(var > 1e-30, var, 1)), 0), n)
        else:
            product = _by_tiles(held, m)
        values, vectors = leading_components(product, m, limit * m / n)
    finally:
        held.unpersist()
    sent, blocks = spark.sparkContext.broadcast(vectors), -(-m // SIDE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column("id").to_pylist():
                i, j = (np.arange(b * SIDE, min(m, (b + 1) * SIDE)) for b in divmod(block, blocks))
                yield cells(i, j, (sent.value[i] * values) @ sent.value[j].T)

    return spark.range(blocks * blocks).repartition(min(blocks * blocks, 200)).mapInArrow(run, "i int, j int, corr double"), {"lambda_plus": float(limit), "n_signal": len(values)}


def two_windows(traces: DataFrame, reference: tuple[int, int], search: tuple[int, int]) -> DataFrame:
    """Search x reference correlation: search, ref, corr, indices from 0 in each window."""
    return rectangle(traces, search, reference).select(F.col("i").alias("search"), F.col("j").alias("ref"), "corr")


def estimate(n_samples: int, stride: int) -> dict[str, int]:
    """Matrix side and bytes of the float32 result before running."""
    m = -(-n_samples // stride)
    return {"side": m, "bytes": 4 * m * m}
