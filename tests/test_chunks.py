"""Chunked traces against whole rows, and TRS files read and written by ranges."""

import builtins
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

from tracewright import model
from tracewright.operators import chunks
from tracewright.operators import transforms as tx
from tracewright.sources import trs

LENGTHS = [1, 7, 40, 64, 100]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i + 2**40, (100 + rng.standard_normal(n)).astype(np.float32).tolist()) for i, n in enumerate(LENGTHS)] + [(3, []), (4, None)]
    return spark.createDataFrame(data, "trace_idx long, samples array<float>").repartition(2).cache()


@pytest.mark.parametrize("size", [3, 16, 500])
def test_transforms_equal_whole_rows(spark, rows, size):
    cut = chunks.to_chunks(rows, size).cache()
    assert {r.trace_idx: r.samples for r in chunks.to_rows(cut).collect()} == {r.trace_idx: r.samples for r in rows.collect() if r.samples}
    steps = [tx.absolute(), tx.moving_average(1), tx.moving_average(3), tx.moving_average(5), tx.moving_average(33), tx.window_resample(1), tx.window_resample(4), tx.window_resample(40), tx.stride_resample(7), tx.stft_magnitude(16, 5), tx.stft_magnitude(2, 9, "rect"), tx.gaussian_noise(0.5, 9)]
    named = lambda df, i: df.select(F.lit(i).alias("step"), "trace_idx", "samples")
    found, wanted = None, None
    for i, step in enumerate(steps):
        a, b = named(chunks.to_rows(chunks.run_pipeline(cut, size, [step])), i), named(step(rows), i)
        found, wanted = (a, b) if found is None else (found.unionByName(a), wanted.unionByName(b))
    found = {(r.step, r.trace_idx): r.samples for r in found.collect()}
    wanted = {(r.step, r.trace_idx): r.samples for r in wanted.collect() if r.samples}
    assert found.keys() == wanted.keys()
    for k, x in wanted.items():
        assert len(found[k]) == len(x) and np.allclose(found[k], x, rtol=2e-6, atol=2e-6), (k, steps[k[0]].name)


def test_whole_trace_steps_are_refused_and_ranges(spark, rows):
    cut = chunks.to_chunks(rows, 16)
    with pytest.raises(ValueError, match="whole traces"):
        chunks.run_pipeline(cut, 16, [tx.fft_magnitude()])
    found = {r.trace_idx: r.samples for r in chunks.to_rows(chunks.sample_range(cut, 16, 30, 50)).collect()}
    assert found == {r.trace_idx: r.samples[30:80] for r in rows.collect() if r.samples and len(r.samples) > 30}


@pytest.fixture
def counted(monkeypatch):
    """The bytes read from files that this process opens."""
    read, plain = [0], builtins.open

    def counting(path, mode="r", *a, **k):
        f = plain(path, mode, *a, **k)
        if not str(path).endswith(".trs") or "b" not in mode:
            return f

        class Counted:
            def read(self, n=-1):
                raw = f.read(n)
                read[0] += len(raw)
                return raw

            def __getattr__(self, name):
                return getattr(f, name)

            def __enter__(self):
                return self

            def __exit__(self, *x):
                f.close()

        return Counted()

    monkeypatch.setattr(builtins, "open", counting)
    return read


def test_reader_reads_no_more_than_it_must(tmp_path, counted):
    ns, n, dl = 1000, 50, 16
    path = tmp_path / "a.trs"
    body = b"".join(bytes([i] * dl) + np.full(ns, i, "<f4").tobytes() for i in range(n))
    path.write_bytes(trs.header_bytes(n, ns, dl) + body)
    rest = StringContains(("data",), "x")

    def read(columns, filters=(), **options):
        counted[0] = 0
        reader = trs.TrsReader({"path": str(path), **{k: str(v) for k, v in options.items()}}, columns)
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        return rows, left, counted[0] - 30  # the header's bytes, about

    rows, left, used = read(["trace_idx", "data"])
    assert len(rows) == n and rows[7]["data"] == bytes([7] * dl) and used < n * dl + 100
    rows, left, used = read(["trace_idx", "samples"], [GreaterThanOrEqual(("trace_idx",), 10), LessThan(("trace_idx",), 12), rest])
    assert [r["trace_idx"] for r in rows] == [10, 11] and left == [rest] and used < 2 * 4 * ns + 100
    rows, _, used = read(["trace_idx", "samples", "data"], [In(("trace_idx",), (3, 49, 77))], first_sample=990, n_samples=50)
    assert [(r["trace_idx"], r["samples"]) for r in rows] == [(3, [3.0] * 10), (49, [49.0] * 10)] and used < 200
    rows, _, used = read(["trace_idx", "chunk", "samples"], [EqualTo(("trace_idx",), 5)], chunk_samples=300)
    assert [(r["chunk"], len(r["samples"])) for r in rows] == [(0, 300), (1, 300), (2, 300), (3, 100)] and used < 4 * ns + 100
    assert read(["trace_idx", "samples", "data"])[2] < len(body) + 100
    assert read(["trace_idx"])[2] < 100


def test_bad_headers_are_known_at_once(tmp_path, counted):
    path = tmp_path / "b.trs"
    path.write_bytes(trs._object(0x41, struct.pack("<I", 1)) + trs._object(0x42, struct.pack("<I", 0)) + trs._object(0x43, b"\x14") + b"\x5f\x00" + b"\0" * (8 << 20))
    with pytest.raises(ValueError, match="no samples"):
        trs.read_layout(str(path))
    assert counted[0] < 100
    path.write_bytes(b"\x99\x84" + struct.pack("<I", 5 << 20) + b"z" * (5 << 20) + trs.header_bytes(2, 3))
    counted[0] = 0
    assert trs.read_layout(str(path)).header.n_samples == 3 and counted[0] < 100


def test_trs_pushes_filters_and_prunes(spark, tmp_path):
    path = str(tmp_path / "c.trs")
    traces = model.from_arrays(spark, np.arange(60, dtype=np.float32).reshape(6, 10), np.arange(12).reshape(6, 2))
    trs.write_trs(traces.df, path)
    with pytest.raises(Exception, match="there already"):
        trs.write_trs(traces.df.limit(2), path)
    some = trs.open_trs(spark, path, first_sample=2, n_samples=3).df.where("trace_idx BETWEEN 2 AND 3")
    assert [(r.trace_idx, r.samples, bytes(r.data)) for r in some.orderBy("trace_idx").collect()] == [(2, [22.0, 23.0, 24.0], b"\x04\x05"), (3, [32.0, 33.0, 34.0], b"\x06\x07")]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan trs" in plan and "Filter (" not in plan and ") Filter" not in plan  # the reader has taken them
    assert trs.open_trs(spark, path, columns=("trace_idx", "data")).df.columns == ["trace_idx", "data"]


def test_chunks_are_written_and_read(spark, tmp_path):
    path = str(tmp_path / "d.trs")
    x = np.random.default_rng(6).standard_normal((4, 103)).astype(np.float32)
    traces = model.from_arrays(spark, x, np.arange(8).reshape(4, 2))
    cut = chunks.run_pipeline(chunks.to_chunks(traces.df, 10).repartition(5), 10, [tx.negate()])
    trs.write_trs_chunks(cut, path, traces.df.select("trace_idx", "data"))
    back = trs.open_trs(spark, path)
    assert (back.header.n_traces, back.header.n_samples, back.header.data_length) == (4, 103, 2)
    got = back.df.orderBy("trace_idx").collect()
    assert np.array_equal(np.array([r.samples for r in got], np.float32), -x) and [bytes(r.data) for r in got] == [bytes([2 * i, 2 * i + 1]) for i in range(4)]
    again = trs.open_trs_chunks(spark, path, 16, rows_per_partition=3)
    assert again.rdd.getNumPartitions() > 4
    assert np.array_equal(np.array([r.samples for r in chunks.to_rows(again).orderBy("trace_idx").collect()], np.float32), -x)
    short = cut.where("NOT (trace_idx = 2 AND chunk = 10)")
    with pytest.raises(Exception, match="different length"):
        trs.write_trs_chunks(short, path, traces.df.select("trace_idx", "data"), overwrite=True)
