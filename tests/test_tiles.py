"""Correlation tiles and cleaned matrices against dense numpy."""

import numpy as np
import pytest

from tracewright import model
from tracewright.operators import tiles, xcorr


def full(df, m, k=None):
    out = np.zeros((m, k or m))
    for r in df.collect():
        out[r.i, r.j] += r["corr"]
    return out


def test_tiles_equal_numpy(spark):
    x = (30_000 + np.random.default_rng(1).standard_normal((60, 30)).cumsum(axis=1)).astype(np.float32)
    x[:, 7] = 5
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)]
    df = spark.createDataFrame(rows, "trace_idx int, samples array<float>").repartition(5)
    with np.errstate(all="ignore"):
        want = np.nan_to_num(np.corrcoef(x.T.astype(np.float64)))
    for side, panel in ((512, 4096), (4, 64), (4, 12)):
        found = tiles.correlation_cells(tiles.moment_tiles(df, (0, 30), None, 2, side, panel), True, side)
        assert found.count() == 15 * 15 and np.allclose(full(found, 15), want[::2, ::2], atol=1e-9), (side, panel)
        found = tiles.correlation_cells(tiles.moment_tiles(df, (3, 25), (10, 14), 2, side, panel), False, side)
        assert found.count() == 13 * 7 and np.allclose(full(found, 13, 7), want[3:28:2, 10:24:2], atol=1e-9), (side, panel)
    assert np.allclose(full(xcorr.correlation(df, 30), 30), want, atol=1e-9)
    assert tiles.moment_tiles(df, (0, 30), None, 1, 4, 12).select("bi", "bj").distinct().count() == 8 * 9 // 2


def test_ragged_traces_are_filled_with_zeros(spark):
    x = np.random.default_rng(2).standard_normal((9, 5)).astype(np.float32)
    df = spark.createDataFrame([(i, r[: 5 - i % 2].tolist()) for i, r in enumerate(x)], "trace_idx int, samples array<float>")
    x[1::2, 4] = 0
    assert np.allclose(full(xcorr.correlation(df, 5), 5), np.corrcoef(x.T.astype(np.float64)), atol=1e-9)


def test_leading_components_equal_dense():
    rng = np.random.default_rng(3)
    for m, block in ((40, 4), (120, 16), (3, 16)):
        q = np.linalg.qr(rng.standard_normal((m, m)))[0]
        d = np.concatenate([[9.0, 9.0, 7.5][: min(3, m)], rng.uniform(0, 2, max(0, m - 3))])
        a = (q * d) @ q.T
        values, vectors = xcorr.leading_components(lambda v: a @ v, m, 3.0, block)  # noqa: B023
        assert np.allclose(values, [9, 9, 7.5]) and np.allclose((vectors * values) @ vectors.T, (q[:, :3] * d[:3]) @ q[:, :3].T, atol=1e-7)
    assert xcorr.leading_components(lambda v: v * 0, 5, 1.0)[0].tolist() == []


@pytest.mark.parametrize(("n", "m"), [(200, 30), (25, 40)])
def test_cleaned_equals_dense(spark, n, m):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((n, m)) + 3 * np.outer(rng.standard_normal(n), rng.standard_normal(m)) + 1000
    x[:, 3] = 2
    x = x.astype(np.float32)
    df = model.from_arrays(spark, x).df.repartition(4)
    found, info = xcorr.correlation_cleaned(df, m)
    y = x.astype(np.float64) - x.mean(axis=0, dtype=np.float64)
    sd = y.std(axis=0)
    z = np.where(sd > 1e-15, y / np.where(sd > 1e-15, sd, 1), 0)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    keep = values * n / m > (1 + np.sqrt(n / m)) ** 2
    assert info["n_signal"] == keep.sum() > 0
    assert np.allclose(full(found, m), (vectors[:, keep] * values[keep]) @ vectors[:, keep].T, atol=1e-6)
