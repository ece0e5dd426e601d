"""Per-sample statistics over traces: Welch t-test, signal-to-noise ratios, spectra, ranges.

Every statistic is one aggregation of mergeable sums by sample (and class), followed by a closed
formula, so partial aggregation leaves samples x classes x partitions rows to shuffle. Degenerate
cases give 0.0, never null, NaN or an error of the engine. Traces without samples (null) are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalar import decibel, threshold, window_coefficient
from tracewright.model import byte_at, to_long
from tracewright.operators.projections import prepared
from tracewright.operators.transforms import window_values


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).otherwise(F.lit(0.0))


def group_by_byte(traces: DataFrame, i: int) -> DataFrame:
    """Group 1 where the byte is not 0; traces without that byte are left out."""
    return traces.where(F.octet_length("data") > i).withColumn("grp", (byte_at(F.col("data"), i) != 0).cast("int"))


def ttest_sums(long: DataFrame) -> DataFrame:
    """Of either group by sample: n (values), s and q (sums of values and of squares) and d, the sum of squares
    around the group's mean, which is merged rather than subtracted and so keeps its digits; other groups
    are ignored."""
    sums = []
    for g in (0, 1):
        v = F.when(F.col("grp") == g, F.col("v"))
        n = F.count(v)
        sums += [n.alias(f"n{g}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"s{g}"), F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"q{g}"), F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias(f"d{g}")]
    return long.groupBy("sample_idx").agg(*sums)


def accumulators(traces: DataFrame) -> DataFrame:
    """``ttest_sums`` of traces with a ``grp`` column, a trace counting once in n0 or n1 whatever its length."""
    return _with_counts(ttest_sums(to_long(prepared(traces), keep=("grp",))), group_counts(prepared(traces)))


def _with_counts(sums: DataFrame, counts: DataFrame | None) -> DataFrame:
    """The sums with n0, n1 of whole groups (one row, else the largest of any sample) and the values present
    as k0, k1."""
    if counts is None:
        counts = sums.agg(F.coalesce(F.max("n0"), F.lit(0)).alias("n0"), F.coalesce(F.max("n1"), F.lit(0)).alias("n1"))
    return sums.withColumnsRenamed({"n0": "k0", "n1": "k1"}).join(F.broadcast(counts))


def _centred(k: Column, s: Column, d: Column, n: Column) -> Column:
    """Sum of squares around s / n where n - k values are missing: those add nothing to the sums."""
    return d + ratio(s * s, k.cast("double")) * (n - k) / F.greatest(n, F.lit(1))


def welch(sums: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """sample_idx, t, df, n0, n1 from the sums. Traces that miss a sample count in n all the same;
    without ``counts`` (n0, n1) n is that of the sample that most traces have."""
    out = _with_counts(sums, counts)
    for g in (0, 1):
        n, k, s, d = (F.col(f"{c}{g}") for c in "nksd")
        out = out.withColumn(f"m{g}", ratio(s, n.cast("double")))
        out = out.withColumn(f"e{g}", F.when(n > 1, _centred(k, s, d, n) / F.greatest(n - 1, F.lit(1)) / F.greatest(n, F.lit(1))).otherwise(F.lit(0.0)))
    both = F.col("e0") + F.col("e1")
    below = F.col("e0") * F.col("e0") / F.greatest(F.col("n0") - 1, F.lit(1)) + F.col("e1") * F.col("e1") / F.greatest(F.col("n1") - 1, F.lit(1))
    t = ratio(F.col("m0") - F.col("m1"), F.sqrt(both))
    df = F.when(below > 1e-300, both * both / F.when(below > 1e-300, below)).otherwise((F.col("n0") + F.col("n1") - 2).cast("double"))
    return out.select("sample_idx", t.alias("t"), df.alias("df"), "n0", "n1")


def ttest(traces: DataFrame, start: int = 0, count: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """Welch t of traces with a ``grp`` column: sample_idx, t, df, n0, n1. Both groups need two traces. Range, shifts
    and pipeline as in ``projections.prepared``."""
    traces = prepared(traces, start, count, shifts, pipeline)
    few = F.raise_error(F.lit("both groups need two traces at least")).cast("long")
    counts = group_counts(traces).select(F.when((F.col("n0") < 2) | (F.col("n1") < 2), few).otherwise(F.col("n0")).alias("n0"), "n1")
    return welch(ttest_sums(to_long(traces, keep=("grp",))), counts)


def group_counts(traces: DataFrame) -> DataFrame:
    return traces.agg(F.count_if(F.col("grp") == 0).alias("n0"), F.count_if(F.col("grp") == 1).alias("n1"))


def median_df(tstats: DataFrame, n0: int = 1, n1: int = 1) -> DataFrame:
    """The upper median of df; n0 + n1 - 2 where there is none."""
    n = tstats.where("df IS NOT NULL").count()
    found = at_ranks(tstats, "df", [n // 2])[0] if n else float(n0 + n1 - 2)
    return tstats.sparkSession.createDataFrame([(found,)], "median_df double")


def ttest_threshold(tstats: DataFrame, alpha: float = 0.001) -> DataFrame:
    """median_df, n_samples and the corrected threshold of a t-test result."""
    n = tstats.agg(F.count(F.lit(1)).alias("n_samples"))
    return median_df(tstats).crossJoin(n).withColumn("threshold", threshold(F.lit(alpha), F.col("n_samples").cast("double"), F.col("median_df")))


def over_threshold(tstats: DataFrame, limit: float = 4.5, one_sided: bool = False) -> DataFrame:
    return tstats.where((F.col("t") if one_sided else F.abs("t")) >= limit)


def snr_sums(long: DataFrame, n_classes: int) -> DataFrame:
    """Of each class by sample: n (values), s, q (sums of values and squares) and d (of squares around the mean)."""
    known = long.where((F.col("cls") >= 0) & (F.col("cls") < n_classes))
    return known.groupBy("sample_idx", "cls").agg(F.count("v").alias("n"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0)).alias("q"), F.coalesce(F.var_pop("v") * F.count("v"), F.lit(0.0)).alias("d"))


def snr_of(sums: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """sample_idx, snr. Classes of one trace add to the signal, not to the noise. Traces that miss a sample
    count all the same, as do classes of which no trace has it (mean 0); without ``counts`` (cls, n; at most
    256 rows) n is that of the sample that most traces of a class have."""
    if counts is None:
        counts = sums.groupBy("cls").agg(F.max("n").alias("n"))
    whole = counts.agg(F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("usable"))
    rows = sums.withColumnRenamed("n", "k").join(F.broadcast(counts), "cls")
    mean = F.col("s") / F.col("n")
    noise = F.when(F.col("n") > 1, F.col("n") * _centred(F.col("k"), F.col("s"), F.col("d"), F.col("n")) / F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.lit(0.0))
    by = Window.partitionBy("sample_idx")
    rows = rows.join(F.broadcast(whole)).select("sample_idx", "n", mean.alias("m"), noise.alias("noise"), "total", "usable", (F.sum("s").over(by) / F.col("total")).alias("grand"))
    apart = F.col("m") - F.col("grand")
    found = rows.groupBy("sample_idx").agg(F.sum(F.col("n") * apart * apart).alias("signal"), F.sum("noise").alias("noise"), F.sum("n").alias("present"), F.first("grand").alias("grand"), F.first("total").alias("total"), F.first("usable").alias("usable"))
    signal = F.col("signal") + (F.col("total") - F.col("present")) * F.col("grand") * F.col("grand")
    return found.select("sample_idx", F.when(F.col("usable") < 2, F.raise_error(F.lit("two classes with two traces each are needed")).cast("double")).otherwise(ratio(signal, F.col("noise"))).alias("snr"))


def snr(traces: DataFrame, n_classes: int, start: int = 0, count: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """Signal-to-noise ratio of traces with a ``cls`` column; range, shifts and pipeline as in ``projections.prepared``."""
    traces = prepared(traces, start, count, shifts, pipeline)
    return snr_of(snr_sums(to_long(traces, keep=("cls",)), n_classes), class_counts(traces, n_classes))


def class_counts(traces: DataFrame, n_classes: int) -> DataFrame:
    return traces.where((F.col("cls") >= 0) & (F.col("cls") < n_classes)).groupBy("cls").agg(F.count(F.lit(1)).alias("n"))


def static_snr(long: DataFrame) -> DataFrame:
    """|mean| / sample deviation by sample; needs two traces."""
    sums = long.groupBy("sample_idx").agg(F.avg("v").alias("m"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))
    return sums.select("sample_idx", ratio(F.abs("m"), F.col("sd")).alias("snr"))


def summary(vector: DataFrame, column: str) -> DataFrame:
    return vector.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.avg(column).alias("mean"))


def trace_stats(long: DataFrame) -> DataFrame:
    return long.groupBy("trace_idx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"))


def spectrum_terms(long: DataFrame, n: int, window: str = "hann") -> DataFrame:
    """Real and imaginary sums of each trace's windowed DFT: trace_idx, bin, re, im. The exact SQL
    form; ``transforms.fft_magnitude`` is the fast one."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(n // 2)))
    rows = long.withColumn("x", F.col("v") * window_coefficient(window, F.col("sample_idx"), F.lit(n))).select("trace_idx", "sample_idx", "x", bins.alias("bin"))
    angle = F.lit(2 * math.pi) * ((F.col("sample_idx") * F.col("bin")) % n) / F.lit(float(n))
    return rows.groupBy("trace_idx", "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(-F.col("x") * F.sin(angle)).alias("im"))


def bin_magnitude(terms: DataFrame, n: int) -> DataFrame:
    """trace_idx, bin, mag: |X| / n, inner bins doubled (the last bin never is)."""
    double = F.when((F.col("bin") > 0) & (F.col("bin") < n // 2), F.lit(2.0)).otherwise(F.lit(1.0))
    return terms.select("trace_idx", "bin", "re", "im", (F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n * double).alias("mag"))


def average_spectrum(terms: DataFrame, n: int, output: str = "magnitude") -> DataFrame:
    """Mean, minimum and maximum over traces of magnitude, dB or phase by bin."""
    value = {"magnitude": F.col("mag"), "db": decibel(F.col("mag")), "phase": F.atan2(F.col("im"), F.col("re"))}[output]
    return bin_magnitude(terms, n).groupBy("bin").agg(F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def mean_spectrum(traces: DataFrame, n: int, output: str = "magnitude", window: str = "hann") -> DataFrame:
    """As ``average_spectrum`` of ``spectrum_terms``, by a fast transform and one row per bin and task. Traces
    of fewer than two samples are skipped; others are cut or padded with zeros to ``n``."""
    weights = window_values(window, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = n // 2 + 1
        total, lo, hi, count = np.zeros(bins), np.full(bins, np.inf), np.full(bins, -np.inf), 0
        for batch in batches:
            rows = [r for r in batch.column("samples").to_pylist() if r is not None and len(r) >= 2]
            if not rows:
                continue
            x = np.zeros((len(rows), n))
            for i, r in enumerate(rows):
                x[i, : min(n, len(r))] = r[:n]
            f = np.fft.rfft(x * weights, axis=1)
            if output == "phase":
                value = np.arctan2(f.imag, f.real)
            else:
                value = np.abs(f) / n
                value[:, 1:-1] *= 2
                if output == "db":
                    value = np.where(value > 1e-10, 20 * np.log10(np.maximum(value, 1e-10)), -200.0)
            total, lo, hi, count = total + value.sum(0), np.minimum(lo, value.min(0)), np.maximum(hi, value.max(0)), count + len(rows)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins, dtype=np.int32)), *map(pa.array, (total, lo, hi, np.full(bins, float(count))))], ["bin", "s", "lo", "hi", "c"])

    sums = traces.select("samples").mapInArrow(run, "bin int, s double, lo double, hi double, c double")
    return sums.groupBy("bin").agg((F.sum("s") / F.sum("c")).alias("mean"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def frequency_axis(vector: DataFrame, x_scale: float, n: int) -> DataFrame:
    """Adds each bin's frequency: in hertz where the scale is seconds per sample, else the bin number."""
    step = 1 / x_scale / n if 0 < x_scale < 1 else 1.0
    return vector.withColumn("frequency", F.col("bin") * F.lit(step))


def y_range(long: DataFrame) -> DataFrame:
    """Display range: 5 % beyond the extremes, one beyond a flat value, [-1, 1] without samples."""
    e = long.agg(F.min("v").alias("a"), F.max("v").alias("b"))
    pad = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise((F.col("b") - F.col("a")) * F.lit(0.05))
    return e.select(F.coalesce(F.col("a") - pad, F.lit(-1.0)).alias("lo"), F.coalesce(F.col("b") + pad, F.lit(1.0)).alias("hi"))


def color_range(matrix: DataFrame, value: str) -> DataFrame:
    most = F.coalesce(F.max(F.abs(value)), F.lit(0.0))
    return matrix.agg((-most).alias("lo"), most.alias("hi"))


#: Bits of a key that one pass of the selection settles; values so few that the driver takes them to end it.
DIGIT, FEW = 16, 1 << 15


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit keys in the order of doubles: negative ones turned over, NaN last."""
    bits = np.where(np.isnan(values), np.nan, values).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def at_ranks(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at ranks (from 0) of a column's sorted values, nulls left out, by radix descent: each of four
    passes counts the next 16 bits of the keys that begin as a wanted one does, until at most ``FEW`` values begin
    so. Tasks send counts alone, at most 65,536 for each rank; no task sorts, and ties, outliers and constant
    columns cost the same."""
    column = df.select(F.col(value).cast("double").alias("x")).where("x IS NOT NULL").persist()
    prefixes, left, among = [0] * len(ranks), list(ranks), [FEW + 1] * len(ranks)
    try:
        for shift in range(64 - DIGIT, -1, -DIGIT):
            wanted = sorted(set(prefixes))
            if max(among, default=0) <= FEW:

                def begin(batches: Iterator[pa.RecordBatch], wanted=wanted, shift=shift) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        keys = _keys(batch.column("x").to_numpy(zero_copy_only=False)) >> np.uint64(shift + DIGIT)
                        yield batch.filter(pa.array(np.isin(keys, np.array(wanted, np.uint64))))

                few = np.array([r.x for r in column.mapInArrow(begin, "x double").collect()])
                keys = np.sort(_keys(few))
                own = [keys[keys >> np.uint64(shift + DIGIT) == np.uint64(p)] for p in prefixes]
                prefixes = [int(k[at]) for k, at in zip(own, left, strict=True)]
                break

            def count(batches: Iterator[pa.RecordBatch], wanted=wanted, shift=shift) -> Iterator[pa.RecordBatch]:
                seen = {p: np.zeros(1 << DIGIT, np.int64) for p in wanted}
                for batch in batches:
                    keys = _keys(batch.column("x").to_numpy(zero_copy_only=False))
                    for p, c in seen.items():
                        own = keys if shift + DIGIT == 64 else keys[keys >> np.uint64(shift + DIGIT) == np.uint64(p)]
                        c += np.bincount((own >> np.uint64(shift) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
                for i, c in enumerate(seen.values()):
                    at = np.flatnonzero(c)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(c[at])], ["prefix", "digit", "n"])

            rows = column.mapInArrow(count, "prefix int, digit int, n long").groupBy("prefix", "digit").agg(F.sum("n").alias("n")).collect()
            table = np.zeros((len(wanted), 1 << DIGIT), np.int64)
            for r in rows:
                table[r.prefix, r.digit] = r.n
            for i, p in enumerate(prefixes):
                up_to = np.cumsum(table[wanted.index(p)])
                if left[i] >= up_to[-1]:
                    raise ValueError("rank beyond the number of values")
                digit = int(np.searchsorted(up_to, left[i], side="right"))
                left[i] -= int(up_to[digit - 1]) if digit else 0
                among[i] = int(table[wanted.index(p)][digit])
                prefixes[i] = p << DIGIT | digit
    finally:
        column.unpersist()
    keys = np.array(prefixes, np.uint64)
    return np.where(keys >> np.uint64(63) == 1, keys ^ np.uint64(1 << 63), ~keys).view(np.float64).tolist()


def clip_range(matrix: DataFrame, value: str, p: float, display: tuple[float, float] = (-1.0, 1.0)) -> DataFrame:
    """lo, hi: the values at the ranks floor(p (n-1)) and floor((1-p) (n-1)), p held within 0 and 1. An upper bound that
    does not exceed the lower becomes the lower plus 1e-6; without values the display range stays."""
    n = matrix.where(F.col(value).isNotNull()).count()
    lo, hi = display
    if n:
        lo, hi = at_ranks(matrix, value, [math.floor(min(max(q, 0.0), 1.0) * (n - 1)) for q in (p, 1 - p)])
        hi = hi if hi > lo else lo + 1e-6
    return matrix.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")
