"""NPY and NPZ files read by ranges and written by tasks, against numpy and zipfile."""

import builtins
import json
import zipfile
import zlib
from dataclasses import asdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import GreaterThanOrEqual

from tracewright import model
from tracewright.sources import npy
from tracewright.sources.shared import joined_crc


def test_joined_crc():
    rng = np.random.default_rng(1)
    raw = rng.bytes(5000)
    for cut in (0, 1, 7, 4096, 5000):
        assert joined_crc(zlib.crc32(raw[:cut]), zlib.crc32(raw[cut:]), len(raw) - cut) == zlib.crc32(raw)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_is_read_by_rows(spark, tmp_path, save):
    rng = np.random.default_rng(2)
    x, key, big = rng.integers(-99, 99, (23, 40)).astype("<i2"), rng.integers(0, 255, 23).astype("u1"), rng.integers(0, 2**63, 23).astype("<u8") * 2 + 1
    path = str(tmp_path / "a.npz")
    save(path, other=np.zeros((2, 2, 2)), key=key, traces=x, big=big, data=np.zeros((23, 3), "u1"), short=np.zeros(5))
    t = npy.open_npz(spark, path, rows_per_partition=5, first_sample=10, n_samples=8)
    assert t.header.params == {"key": (0, 1, 1), "big": (1, 8, 2)} and (t.header.n_traces, t.header.n_samples, t.header.data_length) == (23, 40, 9)
    rows = t.df.orderBy("trace_idx").collect()
    assert np.array_equal(np.array([r.samples for r in rows]), x[:, 10:18].astype(np.float32))
    assert [r.key for r in rows] == key.tolist() and [int(r.big) for r in rows] == big.tolist()
    assert [bytes(r.data) for r in rows] == [key[i : i + 1].tobytes() + big[i : i + 1].tobytes() for i in range(23)]
    assert sorted(map(tuple, t.df.where("trace_idx > 20").select("trace_idx", "key").collect())) == [(i, int(key[i])) for i in (21, 22)]


def test_npz_without_vectors(spark, tmp_path):
    path = str(tmp_path / "b.npz")
    np.savez(path, first=np.arange(6.0).reshape(3, 2), labels=np.array([[257.0, 2], [3, 4], [5, 300]]))
    t = npy.open_npz(spark, path)
    assert [(r.samples, bytes(r.data)) for r in t.df.orderBy("trace_idx").collect()] == [([0, 1], b"\1\2"), ([2, 3], b"\3\4"), ([4, 5], b"\5\x2c")]
    np.savez(path, vector=np.zeros(3))
    with pytest.raises(ValueError, match="two-dimensional"):
        npy.open_npz(spark, path)


def test_reader_seeks(tmp_path, monkeypatch):
    x = np.arange(100_000, dtype="<f4").reshape(100, 1000)
    path = str(tmp_path / "c.npy")
    np.save(path, x)
    spec = json.dumps({"traces": asdict(npy.npy_at(path)), "data": None, "named": {}})
    read, plain = [0], builtins.open

    def counting(*a, **k):
        f = plain(*a, **k)

        class Counted:
            def read(self, n):
                read[0] += n
                return f.read(n)

            def __getattr__(self, name):
                return getattr(f, name)

            def __enter__(self):
                return self

            def __exit__(self, *e):
                f.close()

        return Counted()

    monkeypatch.setattr(builtins, "open", counting)

    def rows(columns, **options):
        read[0] = 0
        reader = npy.ArrayReader({"arrays": spec, **options}, columns)
        assert list(reader.pushFilters([GreaterThanOrEqual(("trace_idx",), 97)])) == []
        return [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]

    assert [r["trace_idx"] for r in rows(["trace_idx"])] == [97, 98, 99] and read[0] == 0
    assert [r["samples"] for r in rows(["samples"], first_sample="998", n_samples="9")] == x[97:, 998:].tolist() and read[0] == 3 * 8
    assert len(rows(["trace_idx", "samples"])) == 3 and read[0] == 3 * 4000


def test_writers_equal_numpy(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pyspark.sql.DataFrame.toLocalIterator", None)
    x = np.random.default_rng(3).standard_normal((50, 30)).astype(np.float32)
    traces = model.from_arrays(spark, x, np.arange(100).reshape(50, 2)).df.repartition(7)
    npy.write_traces_npy(traces, str(tmp_path / "d.npy"))
    assert np.array_equal(np.load(tmp_path / "d.npy"), x)
    path = str(tmp_path / "e.npz")
    npy.write_traces_npz(traces, path)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == ["traces.npy", "data.npy"]
        assert all(i.CRC == zlib.crc32(z.read(i)) for i in z.infolist())
    assert np.array_equal(np.load(path)["traces"], x) and np.load(path)["data"].tolist() == np.arange(100).reshape(50, 2).tolist()
    with pytest.raises(FileExistsError):
        npy.write_traces_npz(traces, path)
    npy.write_traces_npz(traces, path, {"first": F.col("trace_idx") * 10**12}, overwrite=True)
    assert np.load(path)["first"].tolist() == [i * 10**12 for i in range(50)] and np.load(path).files == ["traces", "first"]
    assert np.array_equal(np.array([r.samples for r in npy.open_npz(spark, path).df.orderBy("trace_idx").collect()], np.float32), x)
    with pytest.raises(Exception, match="different length"):
        npy.write_traces_npy(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "trace_idx int, samples array<float>"), str(tmp_path / "f.npy"))
    npy.write_traces_npz(traces.limit(0), str(tmp_path / "g.npz"))
    assert np.load(tmp_path / "g.npz")["traces"].shape == (0, 0)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["d.npy", "e.npz", "g.npz"]
