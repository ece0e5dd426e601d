"""Views from the pyramid against the extremes of all samples."""

import numpy as np

from tracewright.operators import chunks, display, pyramid


def test_views_equal_all_samples(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, rng.standard_normal(n).astype(np.float32).tolist()) for i, n in enumerate((1000, 777, 5))], "trace_idx int, samples array<float>")
    cut = chunks.to_chunks(rows, 64).cache()
    pyramid.save(pyramid.build(cut, 64, 1000, 4, 2), f"{tmp_path}/p")
    stored = spark.read.parquet(f"{tmp_path}/p")
    assert stored.agg({"level": "max"}).first()[0] == 8
    long = chunks.to_long(cut, 64).cache()
    for start, length, width in ((0, 1000, 10), (3, 900, 7), (100, 50, 100), (500, 5000, 3), (13, 1, 1), (999, 1, 4)):
        got = sorted(map(tuple, pyramid.view(stored, cut, 64, start, length, width, 4, 2).collect()))
        assert got == sorted(map(tuple, display.pixel_extremes(long, start, length, width).select("trace_idx", "pixel", "lo", "hi").collect())), (start, length, width)


def test_what_a_view_needs_follows_its_width():
    for length in (10**5, 10**7, 10**9, 10**12):
        need = pyramid.cover(12_345, length, 1000)
        levels = need.blocks[:, 0].max(initial=0) + 1
        assert len(need.blocks) <= 1000 * (pyramid.FACTOR + 1 + 2 * (pyramid.FACTOR - 1) * levels)
        assert (need.stretches[:, 1] - need.stretches[:, 0]).sum() < 1000 * 2 * pyramid.BASE
        sizes = pyramid.BASE * pyramid.FACTOR ** need.blocks[:, 0]
        assert sizes.sum() + (need.stretches[:, 1] - need.stretches[:, 0]).sum() == length
