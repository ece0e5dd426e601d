"""User models that need all traces at once, and statistics of shifted traces."""

import numpy as np
import pytest

from tracewright import model
from tracewright.operators import cpa, stats
from tracewright.operators import transforms as tx

RANKED = """import numpy as np
def get_leakages(data, hypothesis):
    y = (data[:, 0] ^ hypothesis).astype(float)
    return np.cumsum(y) - y.mean() * data[:, 1]
"""


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    data = rng.integers(0, 256, (700, 2)).astype(np.uint8)
    x = (1e4 + rng.standard_normal((700, 6))).astype(np.float32)
    return x, data, model.from_arrays(spark, x, data).df


@pytest.mark.parametrize("parts", [1, 7])
def test_whole_set_model_equals_numpy(spark, planted, parts, monkeypatch):
    x, data, df = planted
    monkeypatch.setattr(cpa, "TRACES_EACH", 100)
    f = cpa.compile_model(RANKED)
    found = {(r.hypothesis, r.sample_idx): r["corr"] for r in cpa.cpa_user_model(df.repartition(parts), f, 5, row_local=False).collect()}
    want = {(h, j): np.corrcoef(f(data, h).astype(np.float32).astype(np.float64), x[:, j].astype(np.float64))[0, 1] for h in range(5) for j in range(6)}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)


def test_bounds_are_checked_first(planted, monkeypatch):
    df, f = planted[2], cpa.compile_model(RANKED)
    monkeypatch.setattr(cpa, "MAX_SUMS", 100)
    with pytest.raises(ValueError, match="sums of"):
        cpa.cpa_user_model(df, f, 5)
    monkeypatch.setattr(cpa, "MAX_SUMS", 1 << 20)
    monkeypatch.setattr(cpa, "MAX_DATA", 100)
    with pytest.raises(ValueError, match="data of all traces"):
        cpa.cpa_user_model(df, f, 5, row_local=False)


def test_shift_and_pipeline_in_a_statistic(spark):
    x = np.random.default_rng(8).standard_normal((20, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "trace_idx int, samples array<float>, grp int")
    shifts = spark.createDataFrame([(i, i % 5 - 2) for i in range(0, 20, 2)], "trace_idx int, shift int")
    found = {r.sample_idx: r.t for r in stats.ttest(df, 3, 8, shifts, (tx.negate(), tx.window_resample(2))).collect()}
    moved = np.array([[-(r[j] if 0 <= j < 12 else 0) for j in range(3 + s, 11 + s)] for r, s in zip(x, [i % 5 - 2 if i % 2 == 0 else 0 for i in range(20)], strict=True)], np.float32)
    y = moved.reshape(20, 4, 2).mean(axis=2)
    a, b = y[::2].astype(np.float64), y[1::2].astype(np.float64)
    t = (a.mean(0) - b.mean(0)) / np.sqrt(a.var(0, ddof=1) / 10 + b.var(0, ddof=1) / 10)
    assert np.allclose([found[j] for j in range(4)], t, atol=1e-5)
