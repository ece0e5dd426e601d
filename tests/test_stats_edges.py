"""Statistics on ragged, far-off, null, tied and empty input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import stats

SCHEMA = "trace_idx long, samples array<float>, grp int"


def welch_numpy(groups, ns):
    """t by the rule that a trace counts once and adds nothing to the samples it misses."""
    out = []
    for j in range(ns):
        m, e = [], []
        for g in groups:
            x = np.array([row[j] for row in g if len(row) > j], np.float32).astype(np.float64)
            n, mean = len(g), x.sum() / len(g)
            m.append(mean)
            e.append((((x - mean) ** 2).sum() + (n - len(x)) * mean**2) / (n - 1) / n)
        out.append((m[0] - m[1]) / np.sqrt(sum(e)) if sum(e) else 0.0)
    return out


@pytest.mark.parametrize(("offset", "deviation"), [(0, 1), (30_000, 0.02)])
def test_ttest_ragged_and_far_off(spark, offset, deviation):
    rng = np.random.default_rng(1)
    groups = [[(offset + deviation * rng.standard_normal(3 - (i == 3)).astype(np.float64)).astype(np.float32).tolist() for i in range(40)] for _ in range(2)]
    rows = [(10**10 + 100 * g + i, x, g) for g, xs in enumerate(groups) for i, x in enumerate(xs)] + [(1, None, 0), (2, None, 1)]
    found = {r.sample_idx: r for r in stats.ttest(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[j].n0 for j in range(3)] == [40] * 3
    assert np.allclose([found[j].t for j in range(3)], welch_numpy(groups, 3), rtol=1e-6)


def test_snr_ragged(spark):
    rng = np.random.default_rng(2)
    classes = {0: [3, 3, 3], 1: [3, 2, 3, 2], 2: [2, 2], 3: [3]}
    data = {c: [rng.standard_normal(n).astype(np.float32) for n in ns] for c, ns in classes.items()}
    rows = [(10 * c + i, x.tolist(), c) for c, xs in data.items() for i, x in enumerate(xs)] + [(99, None, 0)]
    found = {r.sample_idx: r.snr for r in stats.snr(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("grp", "cls"), 9).collect()}
    for j in range(3):
        n = {c: len(xs) for c, xs in data.items()}
        x = {c: np.array([r[j] for r in xs if len(r) > j], np.float64) for c, xs in data.items()}
        m = {c: x[c].sum() / n[c] for c in x}
        grand = sum(v.sum() for v in x.values()) / sum(n.values())
        noise = sum(n[c] * ((x[c] ** 2).sum() - x[c].sum() ** 2 / n[c]) / (n[c] - 1) for c in x if n[c] > 1)
        assert found[j] == pytest.approx(sum(n[c] * (m[c] - grand) ** 2 for c in x) / noise, rel=1e-9)


@pytest.mark.parametrize("values", [[3.5], [1.0] * 500, [-0.0, 0.0, 1e-300, -1e-300], [1e300, *range(400), -1e300], list(np.random.default_rng(3).standard_normal(1000)), [float("inf"), float("-inf"), 2.0, 2.0]])
@pytest.mark.parametrize("few", [0, 50])
def test_selection_equals_sorting(spark, values, few, monkeypatch):
    monkeypatch.setattr(stats, "FEW", few)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
    ranks = sorted({0, len(values) // 3, len(values) // 2, len(values) - 1})
    assert stats.at_ranks(df, "x", ranks) == [sorted(values)[k] for k in ranks]
    with pytest.raises(ValueError):
        stats.at_ranks(df, "x", [len(values)])


def test_edge_rules(spark):
    flat, none = spark.createDataFrame([(2.0,)] * 5, "x double"), spark.createDataFrame([], "x double")
    assert tuple(stats.clip_range(flat, "x", 0.02).first()) == (2.0, 2.0 + 1e-6)
    assert tuple(stats.clip_range(none, "x", 0.02, (-3.0, 4.0)).first()) == (-3.0, 4.0)
    t = spark.createDataFrame([(5.0,), (1.0,), (9.0,), (7.0,)], "df double")
    assert stats.median_df(t).first()[0] == 7.0
    assert stats.median_df(none.select(F.col("x").alias("df")), 8, 6).first()[0] == 12.0
    assert np.isnan(stats.at_ranks(spark.createDataFrame([(float("nan"),), (1.0,)], "x double"), "x", [1])[0])


def test_null_samples_in_a_spectrum(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0, 4.0]), (1, None)], "trace_idx int, samples array<float>")
    assert stats.mean_spectrum(df, 4).count() == 3
