"""Ranges, shifts, crops and padding of traces and result vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trace_range(traces: DataFrame, first: int, count: int) -> DataFrame:
    """Traces first .. first+count-1; pushed to the scan."""
    return traces.where((F.col("trace_idx") >= first) & (F.col("trace_idx") < first + count))


def read_sample(i: int) -> Column:
    """One sample; 0 out of range."""
    return F.coalesce(F.get("samples", F.lit(i)), F.lit(0.0).cast("float"))


def sample_range(traces: DataFrame, start: int, count: int = 0) -> DataFrame:
    """Samples [start, start+count), clamped to the trace; count 0: to the end."""
    return traces.withColumn("samples", F.slice("samples", start + 1, count or 2**31 - 1 - start))


def stride(traces: DataFrame, k: int) -> DataFrame:
    return traces.withColumn("samples", F.filter("samples", lambda _, i: i % k == 0))


def shifted(traces: DataFrame, shifts: DataFrame | None, start: int = 0, count: int = 0) -> DataFrame:
    """out[j] = samples[start + shift + j], zero outside the trace; traces without a shift have 0.

    The shift table has a row per trace, so it is joined by key and not forced to be broadcast."""
    joined = traces.withColumn("shift", F.lit(0)) if shifts is None else traces.join(shifts, "trace_idx", "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    n = F.lit(count) if count else F.size("samples") - start
    window = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.coalesce(F.get("samples", j + start + F.col("shift")), F.lit(0.0).cast("float")))
    return joined.withColumn("samples", F.when(n > 0, window).otherwise(F.array().cast("array<float>"))).drop("shift")


def prepared(traces: DataFrame, start: int = 0, count: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """What a statistic is taken of: the samples [start, start+count) (0: to the end), moved by each trace's shift
    with zeros outside the trace, then the pipeline. Without shifts the range is cut. Null samples are left out."""
    out = traces.where(F.col("samples").isNotNull())
    if shifts is not None:
        out = shifted(out, shifts, start, count)
    elif start or count:
        out = sample_range(out, start, count)
    for step in pipeline:
        out = step(out)
    return out


NO_RANGE = "the shifted traces have no common valid range"


def common_range(shifts: DataFrame, n_samples: int) -> DataFrame:
    """First and past-last sample index valid for all shifted traces; empty raises at use."""
    found = shifts.agg(F.greatest(F.lit(0), F.max(-F.col("shift"))).alias("start"), F.least(F.lit(n_samples), F.min(F.lit(n_samples) - F.col("shift"))).alias("end"))
    return found.select("start", F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.raise_error(F.lit(NO_RANGE)).cast("int")).alias("end"))


def align_pad(traces: DataFrame, shifts: DataFrame, mode: str = "zero") -> DataFrame:
    """Aligned traces of full length, with zeros (``zero``) or the mean of the trace's valid overlap
    (``avg``) outside, or cut to the common range (``crop``)."""
    joined = traces.join(shifts, "trace_idx", "left").withColumn("shift", F.coalesce("shift", F.lit(0)))
    n = F.size("samples")
    if mode == "crop":
        bounds = joined.agg(F.greatest(F.lit(0), F.max(-F.col("shift"))).alias("a"), F.min(F.least(n, n - F.col("shift"))).alias("b"))
        cut = F.slice("samples", F.col("a") + F.col("shift") + 1, F.col("b") - F.col("a"))
        whole = F.when(F.col("b") > F.col("a"), cut).otherwise(F.raise_error(F.lit(NO_RANGE)).cast("array<float>"))
        return joined.crossJoin(F.broadcast(bounds)).withColumn("samples", whole).drop("a", "b", "shift")
    if mode == "avg":
        overlap = F.filter("samples", lambda _, i: (i - F.col("shift") >= 0) & (i - F.col("shift") < n))
        fill = F.aggregate(overlap, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.size(overlap), F.lit(1))
    else:
        fill = F.lit(0.0)
    return joined.withColumn("fill", fill.cast("float")).withColumn("samples", F.transform("samples", lambda _, j: F.coalesce(F.when(j + F.col("shift") >= 0, F.get("samples", j + F.col("shift"))), F.col("fill")))).drop("fill", "shift")


def crop_ranges(traces: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Concatenates sample ranges [start, end) in list order; ranges may overlap; missing samples are 0."""
    parts = [F.transform(F.sequence(F.lit(a), F.lit(b - 1)), lambda j: F.coalesce(F.get("samples", j), F.lit(0.0).cast("float"))) for a, b in ranges if b > a]
    return traces.withColumn("samples", F.concat(*parts))


def trim(vector: DataFrame, head: int, tail: int, n: int) -> DataFrame:
    """Drops leading and trailing samples of a vector, keeping one at least, and reindexes."""
    a = min(head, n - 1)
    b = max(a + 1, n - tail)
    return vector.where((F.col("sample_idx") >= a) & (F.col("sample_idx") < b)).withColumn("sample_idx", F.col("sample_idx") - a)


def cut(vector: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    """Removes sample ranges [start, end) of a vector and closes the gaps. The new index is the old
    one less the removed samples before it, so nothing is sorted."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    s, out, before = F.col("sample_idx"), vector, F.lit(0)
    for a, b in merged:
        out = out.where(~((s >= a) & (s < b)))
        before = before + F.when(s >= b, F.lit(b - a)).otherwise(F.lit(0))
    return out.withColumn("sample_idx", s - before)


def matrix_rows(matrix: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """The rows of a long matrix as traces."""
    return matrix.groupBy(F.col(row).cast("int").alias("trace_idx")).agg(F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), F.col(value).alias("x")))).alias("e")).select("trace_idx", F.transform("e", lambda p: p["x"].cast("float")).alias("samples"))


def sticky_range(long: DataFrame) -> DataFrame:
    """Running minimum and maximum of each trace up to every sample."""
    w = Window.partitionBy("trace_idx").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("trace_idx", "sample_idx", F.min("v").over(w).alias("lo"), F.max("v").over(w).alias("hi"))


def measure(long: DataFrame) -> DataFrame:
    """Sample and value distance from each pick to the next of its trace."""
    w = Window.partitionBy("trace_idx").orderBy("sample_idx")
    return long.select("trace_idx", "sample_idx", (F.lead("sample_idx").over(w) - F.col("sample_idx")).alias("d_sample"), (F.lead("v").over(w) - F.col("v")).alias("d_value")).where("d_sample is not null")
