import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright import model
from tracewright.functions import scalar as fn
from tracewright.operators import align, cpa, display, projections, stats, xcorr
from tracewright.operators import transforms as tx
from tracewright.sources import npy, trs


def apply(spark, step, values):
    return model.from_arrays(spark, np.array([values], np.float32)).df.transform(step).first()["samples"]


@pytest.mark.parametrize(
    ("step", "values", "want"),
    [
        (tx.absolute(), [-3, 1, -0.5, 0, 2], [3, 1, 0.5, 0, 2]),
        (tx.negate(), [1, -2], [-1, 2]),
        (tx.offset(2.5), [1, 2], [3.5, 4.5]),
        (tx.scale(3), [1, 2], [3, 6]),
        (tx.moving_average(2), [2, 4, 6, 8], [2, 3, 5, 7]),
        (tx.moving_average(9), [2, 4], [2, 3]),
        (tx.window_resample(2), [1, 3, 2, 4, 5, 7], [2, 3, 6]),
        (tx.window_resample(8), [1, 3], []),
        (tx.stride_resample(2), [0, 1, 2, 3, 4, 5], [0, 2, 4]),
        (tx.stride_resample(100), [7, 8, 9], [7]),
        (tx.stft_magnitude(16, 8), [1, 2, 3], []),
        (tx.fft_magnitude(), [5], [5]),
    ],
)
def test_transforms(spark, step, values, want):
    assert apply(spark, step, values) == want
    assert step.length(len(values)) == len(want)


def test_spectra(spark):
    got = apply(spark, tx.fft_magnitude(), np.sin(2 * np.pi * 16 * np.arange(256) / 256))
    assert len(got) == 129 and int(np.argmax(got)) == 16 and abs(got[16] - 1) < 0.05
    frames = np.array(apply(spark, tx.stft_magnitude(256, 128), np.sin(2 * np.pi * 8 * np.arange(1024) / 256))).reshape(7, 129)
    assert (frames.argmax(axis=1) == 8).all()
    noisy = apply(spark, tx.gaussian_noise(0.1, 3), [1, 2, 3, 4])
    assert noisy != [1, 2, 3, 4] and np.allclose(noisy, [1, 2, 3, 4], atol=1)
    assert apply(spark, tx.gaussian_noise(0), [1, 2]) == [1, 2]


@pytest.mark.parametrize("n", [2, 7, 16, 100, 257])
def test_lengths_match(spark, n):
    for step in (tx.window_resample(4), tx.stride_resample(3), tx.fft_magnitude(), tx.stft_magnitude(16, 8)):
        assert len(apply(spark, step, np.ones(n))) == step.length(n)
    with pytest.raises(ValueError):
        tx.pipeline_length([tx.window_resample(10_000)], n)


def grouped(spark, groups):
    rows = [(i, [float(v)], g) for i, (g, v) in enumerate((g, v) for g, vs in groups.items() for v in vs)]
    return spark.createDataFrame(rows, "trace_idx int, samples array<float>, grp int")


def test_welch(spark):
    r = stats.ttest(grouped(spark, {0: [0, 0.2, -0.1, 0.1], 1: [1, 1.2, 0.8, 1.1], 2: [99], -1: [99]})).first()
    assert abs(r.t + 9.1084) < 1e-3 and abs(r.df - 5.5846) < 1e-3 and (r.n0, r.n1) == (4, 4)
    assert stats.ttest(grouped(spark, {0: range(10), 1: range(10)})).first().t == 0
    assert stats.ttest(grouped(spark, {0: [0] * 5, 1: [1] * 5})).first().t == 0
    for few in ({0: [1]}, {0: [1, 2], 1: [3]}):
        with pytest.raises(Exception, match="two traces"):
            stats.ttest(grouped(spark, few)).collect()


def test_snr(spark):
    c0 = [0, 0.1, -0.1, 0, 0, 0.1, -0.1, 0, 0.05, -0.05]
    get = lambda groups: stats.snr(grouped(spark, groups).withColumnRenamed("grp", "cls"), 9).first().snr
    assert abs(get({0: c0, 1: [x + 1 for x in c0], 20: [1]}) - 50) < 1e-4
    assert get({0: [0] * 5, 1: [1] * 5}) == 0
    with pytest.raises(Exception, match="two classes"):
        get({0: c0})


def leaking(spark, n, ns, key, leak, scale=1.0):
    p = (37 * np.arange(n) + 13) & 0xFF
    x = np.zeros((n, ns), np.float32)
    x[:, leak] = scale * np.array([bin(key ^ v).count("1") for v in p])
    x[:, (leak + 1) % ns] = 0.01 * (np.arange(n) % 7)
    return model.from_arrays(spark, x, p[:, None].astype(np.uint8)).df


def test_cpa_recovers_the_key(spark):
    df = leaking(spark, 200, 20, 0xAB, 10, 2)
    for result in (cpa.cpa(df, cpa.hamming_weight_model), cpa.cpa_user_model(df, cpa.check_model(cpa.MODEL_TEMPLATE, df), 256), cpa.cpa(projections.trace_range(df, 20, 150), cpa.hamming_weight_model)):
        top = cpa.top_hypotheses(result).collect()
        assert len(top) == 16 and top[0].hypothesis in (0xAB, 0xAB ^ 0xFF) and top[0].peak > 0.5 and top[0].sample_idx == 10
    assert {r.peak for r in cpa.rank_hypotheses(cpa.cpa(df.withColumn("samples", F.transform("samples", lambda x: x * 0)), cpa.hamming_weight_model, 4)).collect()} == {0.0}
    with pytest.raises(ValueError):
        cpa.compile_model("x = 1")


def test_correlation(spark):
    x = (0.5 + 0.3 * (np.arange(15) % 5))[:, None] * (np.arange(8) + 1)[None]
    df = model.from_arrays(spark, x).df
    for result in (xcorr.correlation(df, 8), xcorr.rectangle(df, (0, 8), (0, 8))):
        got = npy.matrix_to_array(result, "i", "j", "corr", (8, 8))
        assert np.allclose(abs(got), 1, atol=1e-6)
    constant = model.from_arrays(spark, np.ones((20, 32), np.float32)).df
    assert not npy.matrix_to_array(xcorr.correlation(constant, 32, 4), "i", "j", "corr", (8, 8)).any()
    rng = np.random.default_rng(1)
    planted = rng.normal(size=(200, 64))
    planted[:, :8] += 3 * rng.normal(size=(200, 1))
    cleaned, info = xcorr.correlation_cleaned(model.from_arrays(spark, planted).df, 64)
    assert info["n_signal"] == 1 and cleaned.count() == 64 * 64
    two = xcorr.two_windows(df, (0, 3), (2, 5))
    assert two.count() == 15


def test_alignment(spark):
    offsets = [0, 5, -5, 3, -3]
    x = np.zeros((5, 120), np.float32)
    for t, o in enumerate(offsets):
        x[t] = np.maximum(0, 1 - abs(np.arange(120) - 60 - o) / 10)
    df = model.from_arrays(spark, x).df
    for found in (align.align_by_peak(df, 0, (40, 80), 10), align.align_by_correlation(df, 0, (40, 80), 10)):
        assert {r.trace_idx: r.shift for r in found.collect()} == dict(enumerate(offsets))
        moved = projections.shifted(df, found)
        assert all(int(np.argmax(r.samples)) == 60 for r in moved.collect())
    with pytest.raises(ValueError):
        align.align_by_peak(df, 77, (40, 80), 10)


def test_files(spark, tmp_path):
    x = np.arange(40, dtype=np.float32).reshape(5, 8)
    d = np.arange(10, dtype=np.uint8).reshape(5, 2)
    df = model.from_arrays(spark, x, d).df
    path = str(tmp_path / "a.trs")
    trs.write_trs(df.repartition(3), path)
    back = trs.open_trs(spark, path, 2)
    assert (back.header.n_traces, back.header.n_samples, back.header.data_length) == (5, 8, 2)
    rows = back.df.orderBy("trace_idx").collect()
    assert np.array_equal(np.array([r.samples for r in rows]), x) and [bytes(r.data) for r in rows] == [bytes(v) for v in d]
    for code, dtype in ((1, "<i1"), (2, "<i2"), (4, "<i4"), (0x14, "<f4")):
        raw = trs._object(0x41, b"\x02") + trs._object(0x42, b"\x03") + trs._object(0x43, bytes([code])) + trs._object(0x45, b"\x04") + bytes([0x46, 0x82]) + (200).to_bytes(2, "little") + b"t" * 200
        raw += trs._object(0x99, b"zz") + trs._object(0x77, b"\x01\x00\x01\x00K\x01\x10\x00\x02\x00") + b"\x5f\x00"
        for t in range(2):
            raw += b"name" + (np.arange(3) - t).astype(dtype).tobytes()
        (tmp_path / "b.trs").write_bytes(raw)
        s = trs.open_trs(spark, str(tmp_path / "b.trs"))
        assert s.header.params == {"K": (2, 16, 1)} and s.header.title == "t" * 200
        assert [r.samples for r in s.df.orderBy("trace_idx").collect()] == [[0, 1, 2], [-1, 0, 1]]
    for bad in (b"", b"\x41\x01\x02", b"\x41\x7f\x02"):
        with pytest.raises(ValueError):
            trs.parse_header(bad)
    npy.write_traces_npy(df, str(tmp_path / "c.npy"))
    assert np.array_equal(np.load(tmp_path / "c.npy"), x)
    assert np.array_equal(npy.to_matrix(npy.open_npy(spark, str(tmp_path / "c.npy"), 2).df), x)
    npy.write_traces_npz(df, str(tmp_path / "d.npz"))
    z = npy.open_traces(spark, str(tmp_path / "d.npz"))
    assert [bytes(r.data) for r in z.df.orderBy("trace_idx").collect()] == [bytes(v) for v in d]
    np.savez_compressed(tmp_path / "e.npz", traces=x, key=np.arange(5, dtype="<u2"), big=np.arange(5, dtype="<u8"))
    z = npy.open_npz(spark, str(tmp_path / "e.npz"))
    assert z.header.params["key"][:2] == (0, 2) and [r.key for r in z.df.orderBy("trace_idx").collect()] == list(range(5))
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    with pytest.raises(ValueError):
        npy.open_npy(spark, str(tmp_path / "f.npy"))
    t = stats.ttest(model.embeddings_as_traces(spark, "/root/testdata/sf0.001").withColumn("grp", model.byte_at(F.col("data"), 1) % 2))
    npy.write_tstat_npz(t, str(tmp_path / "g.npz"))
    assert npy.read_tstat(spark, str(tmp_path / "g.npz")).count() == 64


def test_labels_and_quantiles(spark):
    rows = [(i, bytearray(b)) for i, b in enumerate([b"", b"\x80", bytes(range(7)), b"\x00\x80\xff\x01\x02\x03\x04\xff", b"\xff" * 9])]
    df = spark.createDataFrame(rows, "i int, data binary")
    got = df.select("i", "data", fn.read_int(F.col("data"), 0, 8).alias("le"), fn.read_int(F.col("data"), 1, 3, True).alias("be"), fn.label_hw(F.col("data"), 0).alias("hw"), fn.label_bit(F.col("data"), 1, 7).alias("bit"), fn.param_value(F.col("data"), 0, 1, 2).alias("p")).collect()
    for r in got:
        b = bytes(r.data)
        assert int(r.le) == int.from_bytes(b[:8], "little") and int(r.be) == int.from_bytes(b[1:4], "big")
        assert r.hw == (bin(b[0]).count("1") if b else 0) and r.bit == (b[1] >> 7 if len(b) > 1 else 0)
        assert int(r.p) == (int.from_bytes(b[:1], "little", signed=True) if b else 0)
    q = spark.range(1).select(fn.inv_norm(F.lit(0.975)).alias("z"), fn.inv_norm(F.lit(0.0)).alias("lo"), fn.inv_t(F.lit(0.975), F.lit(10.0)).alias("t")).first()
    assert abs(q.z - 1.96) < 5e-4 and q.lo == -1e300 and abs(q.t - 2.228) < 5e-3
    assert fn.SBOX[0] == 0x63 and fn.SBOX[0x53] == 0xED and len(set(fn.SBOX)) == 256


def test_streaming_equals_batch(spark, tmp_path):
    from tracewright.streaming.online import online_ttest

    t = model.embeddings_as_traces(spark, "/root/testdata/sf0.001").withColumn("grp", model.byte_at(F.col("data"), 1) % 2)
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = online_ttest(stream, lambda df, i: seen.append(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    batch = {r.sample_idx: r.t for r in stats.ttest(t).collect()}
    assert len(seen) >= 3 and all(math.isclose(r.t, batch[r.sample_idx], abs_tol=1e-9) for r in seen[-1])


def test_shift_trim_cut_and_blur(spark):
    v = spark.createDataFrame([(i, float(i)) for i in range(10)], "sample_idx int, v double")
    assert [(r.sample_idx, r.v) for r in projections.cut(v, [(7, 9), (1, 3), (2, 4)]).orderBy("sample_idx").collect()] == [(0, 0), (1, 4), (2, 5), (3, 6), (4, 9)]
    assert projections.trim(v, 50, 50, 10).count() == 1
    m = spark.createDataFrame([(i, j, 2.0) for i in range(6) for j in range(5)], "i int, j int, corr double")
    assert all(abs(r.value - 2) < 1e-12 for r in display.gaussian_blur(m, 1.0, 6, 5).collect())


def test_the_rest_imports_without_the_text_operators():
    import __spark_entry__ as e

    assert {"agg_ttest", "agg_cpa"} <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
