"""Cases beside the registered queries: offsets, ragged input, blocks, noise, files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalar as fn
from tracewright.model import TRACE_SCHEMA, from_arrays, to_long
from tracewright.operators import cpa, projections, stats, xcorr
from tracewright.operators import transforms as tx
from tracewright.sources import npy, trs


def made(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in x], bytearray(d)) for i, x, d in rows], TRACE_SCHEMA)


def brute_cpa(x, data, n):
    weight = np.array([bin(v).count("1") for v in range(256)], float)
    x = np.asarray(x, np.float32).astype(float)
    out = np.zeros((n, x.shape[1]))
    for h in range(n):
        y = weight[data[:, 0] ^ h]
        for s in range(x.shape[1]):
            out[h, s] = np.corrcoef(x[:, s], y)[0, 1] if x[:, s].std() > 0 and y.std() > 0 else 0.0
    return out


def test_cpa_on_a_large_offset_and_missing_samples(spark):
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, (500, 2), dtype=np.uint8)
    weight = np.array([bin(v).count("1") for v in range(256)], float)
    x = 30_000 + 0.1 * weight[data[:, 0] ^ 3][:, None] + 0.05 * rng.normal(size=(500, 4))
    x[:, 2] = 30_000.1
    want = brute_cpa(x, data, 8)
    df = made(spark, [(i, x[i], data[i].tobytes()) for i in range(500)])
    for result in (cpa.cpa(df, cpa.hamming_weight_model, 8), cpa.cpa_user_model(df, cpa.compile_model(cpa.MODEL_TEMPLATE), 8)):
        got = {(r.hypothesis, r.sample_idx): r["corr"] for r in result.collect()}
        assert max(abs(got[h, s] - want[h, s]) for h in range(8) for s in range(4)) < 1e-6 and got[3, 0] > 0.9 and got[3, 2] == 0.0
    # ragged samples count as 0, ragged data is padded with 0, in whatever batches they come
    lengths, dl = rng.integers(1, 5, 60), rng.integers(1, 4, 60)
    y = rng.normal(size=(60, 4)) + 5
    padded = np.where(np.arange(4) < lengths[:, None], y, 0.0)
    df = made(spark, [(i, y[i, : lengths[i]], data[i].tobytes().ljust(3, b"\1")[: dl[i]]) for i in range(60)]).repartition(7)
    want = brute_cpa(padded, data[:60], 8)
    for result in (cpa.cpa(df, cpa.hamming_weight_model, 8), cpa.cpa_user_model(df, cpa.compile_model(cpa.MODEL_TEMPLATE), 8)):
        got = {(r.hypothesis, r.sample_idx): r["corr"] for r in result.collect()}
        assert max(abs(got[h, s] - want[h, s]) for h in range(8) for s in range(4)) < 1e-6


def test_correlation_in_blocks_and_cleaned(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(200, 1)) @ rng.normal(size=(1, 11)) + rng.normal(size=(200, 11)) + 1000).astype(np.float32)
    df = made(spark, [(i, v, b"") for i, v in enumerate(x)])
    want = np.corrcoef(x.astype(float).T)

    def matrix(result, m):
        out = np.full((m, m), np.nan)
        for r in result.collect():
            out[r.i, r.j] = r["corr"]
        return out

    cleaned, summary = xcorr.correlation_cleaned(df, 11)
    values, vectors = np.linalg.eigh(want)
    limit = (1 + np.sqrt(200 / 11)) ** 2
    keep = values * 200 / 11 > limit
    assert summary["n_signal"] == keep.sum() > 0 and abs(summary["lambda_plus"] - limit) < 1e-9
    assert np.allclose(matrix(cleaned, 11), (vectors[:, keep] * values[keep]) @ vectors[:, keep].T, atol=1e-6)
    assert np.allclose(matrix(xcorr.correlation(df, 11), 11), want, atol=1e-9)
    assert np.allclose(matrix(xcorr.correlation(df, 11, 2), 6), want[::2, ::2], atol=1e-9)
    two = {(r.search, r.ref): r["corr"] for r in xcorr.two_windows(df, (7, 3), (1, 5)).collect()}
    assert all(abs(two[i, j] - want[1 + i, 7 + j]) < 1e-9 for i in range(5) for j in range(3)) and len(two) == 15


def test_noise_keeps_rows_and_has_the_wanted_deviation(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 2000)) * 3
    df = made(spark, [(i // 2, v, b"a") for i, v in enumerate(x)] + [(7, [], b""), (99, [1.0] * 50, b"")])
    got = [r.samples for r in tx.gaussian_noise(0.1, 5)(df).collect()]
    assert sorted(map(len, got)) == [0, 50] + [2000] * 40
    again = tx.gaussian_noise(0.1, 5)(df.repartition(5)).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r.samples) for r in again)
    noise = np.array([g for g in got if len(g) == 2000]) - np.array([v for v, g in zip([*x, [], []], got, strict=True) if len(g) == 2000], np.float32)
    assert abs(noise.std() / (0.1 * 3) - 1) < 0.03 and abs(noise.mean()) < 0.01 and abs((noise**4).mean() / noise.var() ** 2 - 3) < 0.1


def test_moving_average_and_spectrum_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 40)) + 1e4
    df = made(spark, [(i, v, b"") for i, v in enumerate(x)] + [(6, [], b""), (7, [2.0], b"")])
    for w in (1, 4, 100):
        got = {r.trace_idx: r.samples for r in tx.moving_average(w)(df).collect()}
        for i, v in enumerate(x.astype(np.float32).astype(float)):
            assert np.allclose(got[i], [v[max(0, k - w + 1) : k + 1].mean() for k in range(40)], rtol=1e-6)
        assert got[6] == [] and got[7] == [2.0]
    whole = df.where("trace_idx < 6")
    for output in ("magnitude", "db"):
        a = {r.bin: r for r in stats.mean_spectrum(df, 40, output).collect()}
        b = {r.bin: r for r in stats.average_spectrum(stats.spectrum_terms(to_long(whole), 40), 40, output).collect()}
        assert a.keys() == b.keys() and all(abs(a[k][c] - b[k][c]) < 1e-6 for k in a for c in ("mean", "lo", "hi"))


def test_empty_common_range_is_an_error(spark):
    df = made(spark, [(0, range(4), b""), (1, range(4), b"")])
    shifts = spark.createDataFrame([(0, 3), (1, -2)], "trace_idx int, shift int")
    with pytest.raises(Exception, match="no common valid range"):
        projections.align_pad(df, shifts, "crop").collect()
    with pytest.raises(Exception, match="no common valid range"):
        projections.common_range(shifts, 4).collect()


def test_palettes_and_places(spark):
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.1, 0.33, 0.5, 0.99, 1.0, 2.0)], "x double")
    for name, stops in fn.PALETTES.items():
        for r in rows.select("x", fn.colormap(F.col("x"), name).alias("c")).collect():
            want = [int(np.interp(r.x, [s[0] for s in stops], [s[k] for s in stops]) + 1e-9) for k in (1, 2, 3)]
            assert [r.c >> 16, r.c >> 8 & 255, r.c & 255] == want, (name, r.x)
    place = rows.select(fn.color_place(F.col("x"), F.lit(2.0), F.lit(2.0)).alias("p"), fn.color_place(F.col("x"), F.lit(-1.0), F.lit(2.0)).alias("q")).collect()
    assert {r.p for r in place} == {0.5} and place[-1].q == 1.0


def test_trs_files(spark, tmp_path):
    tlv = lambda tag, value: bytes([tag, 0x84]) + len(value).to_bytes(4, "little") + value
    raw = b"".join([tlv(0x41, (2).to_bytes(4, "little")), tlv(0x42, (3).to_bytes(4, "little")), tlv(0x43, b"\x12"), tlv(0x47, b"d" * 2_500_000), b"\x5f\x00"])
    path = str(tmp_path / "a.trs")
    with open(path, "wb") as f:
        f.write(raw + np.array([[1, -2, 300], [4, 5, -600]], "<i2").tobytes())
    assert [r.samples for r in trs.open_trs(spark, path).df.orderBy("trace_idx").collect()] == [[1, -2, 300], [4, 5, -600]]
    matrix = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(3) for j in range(4)], "i int, j int, corr double").repartition(5)
    trs.write_matrix_trs(matrix, "i", "j", "corr", path, overwrite=True)
    assert [r.samples for r in trs.open_trs(spark, path).df.orderBy("trace_idx").collect()] == [[10 * i + j for j in range(4)] for i in range(3)]
    vector = spark.createDataFrame([(i, i / 2) for i in range(6)], "sample_idx int, t double").repartition(3)
    trs.write_vector_trs(vector, "t", path, overwrite=True)
    assert [r.samples for r in trs.open_trs(spark, path).df.collect()] == [[i / 2 for i in range(6)]]
    assert os.listdir(tmp_path) == ["a.trs"]
    # a failed write leaves the file that was there
    with pytest.raises(Exception, match="different length"):
        trs.write_trs(made(spark, [(0, [1.0], b""), (1, [1.0, 2.0], b"")]).coalesce(1), path, overwrite=True)
    assert [len(r.samples) for r in trs.open_trs(spark, path).df.collect()] == [6]


def test_npz_round_trip(spark, tmp_path):
    df = made(spark, [(i, [i, i + 0.5], [i, 255 - i]) for i in range(9)]).repartition(4)
    npy.write_traces_npz(df, str(tmp_path / "a.npz"))
    got = np.load(tmp_path / "a.npz")
    assert got["traces"].dtype == np.float32 and np.array_equal(got["traces"], [[i, i + 0.5] for i in range(9)])
    assert np.array_equal(got["data"], [[i, 255 - i] for i in range(9)])
    npy.write_traces_npz(df, str(tmp_path / "b.npz"), {"first": fn.label_raw(F.col("data"), 0, 1)})
    assert np.load(tmp_path / "b.npz")["first"].tolist() == list(range(9))
    assert [r["first"] for r in npy.open_npz(spark, str(tmp_path / "b.npz")).df.orderBy("trace_idx").collect()] == list(range(9))
    assert from_arrays(spark, got["traces"]).df.count() == 9


def test_noise_makes_and_keeps_only_what_is_asked_for():
    whole = np.random.default_rng([7, 3, 0, 0]).standard_normal(tx.NOISE_BLOCK)
    assert np.array_equal(tx.noise_values(7, 3, 0, 64), whole[:64]) and np.array_equal(tx.noise_values(7, 3, 10, 64), whole[10:74])
    made = tx.noise_values(7, 3, 0, 64)
    assert (made if made.base is None else made.base).nbytes <= 2 * 64 * 8
    assert len(tx.noise_values(7, 3, 4000, 5000)) == 5000 and len(tx.noise_values(7, 3, 4096, 0)) == 0


def test_kernels_see_bounded_parts(spark, monkeypatch):
    rows = [(i, [float(i * j % 11) for j in range(i % 9)] if i % 5 else None) for i in range(60)] + [(99, [1.0] * 50)]
    df = spark.createDataFrame(rows, "trace_idx long, samples array<float>").coalesce(1)
    want = {r.trace_idx: r.samples for r in tx.moving_average(3)(df).collect()}
    batch = df.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(tx, "KERNEL_SAMPLES", 16)
    parts = list(tx._parts(batch))
    assert all(p.num_rows == 1 or len(p.column("samples").flatten()) <= 16 for p in parts) and sum(p.num_rows for p in parts) == len(rows)
    sizes = []
    f = lambda x: (sizes.append(x.size), x)[1]
    assert {r.trace_idx: r.samples for r in tx._kernel(df, f).collect()} == dict(rows)
    assert {r.trace_idx: r.samples for r in tx.moving_average(3)(df).collect()} == want
