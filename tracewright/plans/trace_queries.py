"""The registered trace queries, each with DuckDB SQL for the same rows.

Traces are the rows of ``embeddings`` (64 samples; byte 0 is (37 vec_id + 13) mod 256, byte 1 the
label), or all event values of every user.  Real results are rounded on both sides, and
0.0 is added to turn a negative zero into zero.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import scalar as fn
from tracewright.model import byte_at, embeddings_as_traces, events_chunks, events_long, to_long
from tracewright.operators import align, chunks, cpa, display, projections, pyramid, stats, xcorr
from tracewright.operators import transforms as tx
from tracewright.sources import npy, trs
from tracewright.sources.shared import shared_file

Query = Callable[[SparkSession, str], DataFrame]
NS = 64
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

T = """t AS (SELECT CAST(vec_id AS BIGINT) AS trace_idx, embedding AS x, CAST((vec_id * 37 + 13) % 256 AS INTEGER) AS b0,
  CAST(label AS INTEGER) AS b1 FROM embeddings)"""
L = T + """, l AS (SELECT trace_idx, b0, b1, s, CAST(x[s + 1] AS DOUBLE) AS v FROM (
  SELECT trace_idx, b0, b1, x, CAST(unnest(range(0, 64)) AS INTEGER) AS s FROM t))"""
EVENTS = "l AS (SELECT CAST(user_id AS BIGINT) AS trace_idx, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM events)"
BITS = " + ".join(f"(({{0}} >> {i}) & 1)" for i in range(8))
BOX = "[" + ", ".join(map(str, fn.SBOX)) + "]"


def traces(spark: SparkSession, d: str) -> DataFrame:
    return embeddings_as_traces(spark, d)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def register(name: str, sql: str | None, digits: int = 6):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, d: rounded(f(spark, d), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {name}"


LONG = f"SELECT trace_idx, s AS sample_idx, {r('v', 'v')} FROM l"

# --- reading, ranges and projections ------------------------------------------------------------------

register("src_read_samples", f"WITH {L} SELECT trace_idx, s - 60 AS sample_idx, {r('v', 'v')} FROM l WHERE s >= 60")(lambda s, d: to_long(traces(s, d), 60, 10))
register("src_read_sample", f"WITH {T} SELECT trace_idx, {r('x[5]', 'inside')}, CAST(0 AS DOUBLE) AS outside FROM t")(lambda s, d: traces(s, d).select("trace_idx", projections.read_sample(4).alias("inside"), projections.read_sample(100).alias("outside")))
register("src_read_data", f"WITH {T} SELECT trace_idx, lower(printf('%02x%02x', b0, b1)) AS data FROM t")(lambda s, d: traces(s, d).select("trace_idx", F.lower(F.hex("data")).alias("data")))
register("src_py_plot", f"WITH {L} SELECT trace_idx, s // 4 AS sample_idx, {r('v', 'v')} FROM l WHERE s % 4 = 0")(lambda s, d: to_long(traces(s, d), stride=4))
register("flt_trace_range", f"WITH {T} SELECT trace_idx, b0 FROM t WHERE trace_idx >= 100 AND trace_idx < 150")(lambda s, d: projections.trace_range(traces(s, d), 100, 50).select("trace_idx", byte_at(F.col("data"), 0).alias("b0")))
register("flt_sample_range", f"WITH {L} SELECT trace_idx, s - 10 AS sample_idx, {r('v', 'v')} FROM l WHERE s >= 10 AND s < 20")(lambda s, d: to_long(projections.sample_range(traces(s, d), 10, 10)))
register("flt_stride", f"WITH {L} SELECT trace_idx, s // 5 AS sample_idx, {r('v', 'v')} FROM l WHERE s % 5 = 0")(lambda s, d: to_long(projections.stride(traces(s, d), 5)))


def shifts(t: DataFrame) -> DataFrame:
    return t.where("trace_idx % 2 = 0").select("trace_idx", ((F.col("trace_idx") % 7) - 3).cast("int").alias("shift"))


SHIFTED = f"""WITH {L}, h AS (SELECT trace_idx, CASE WHEN trace_idx % 2 = 0 THEN trace_idx % 7 - 3 ELSE 0 END AS shift FROM t),
g AS (SELECT h.trace_idx, h.shift, CAST(j AS INTEGER) AS j FROM h, range(0, 64) AS q(j)),
a AS (SELECT g.trace_idx, g.shift, g.j, l.v FROM g LEFT JOIN l ON l.trace_idx = g.trace_idx AND l.s = g.j + g.shift)"""
for name in ("prj_shift", "jn_shift", "aln_load_raw", "aln_apply"):
    register(name, SHIFTED + f" SELECT trace_idx, j AS sample_idx, {r('coalesce(v, 0)', 'v')} FROM a")(lambda s, d: to_long(projections.shifted(t := traces(s, d), shifts(t))))
register("prj_align_pad", SHIFTED + f", m AS (SELECT trace_idx, avg(v) AS m FROM a GROUP BY 1) SELECT a.trace_idx, j AS sample_idx, {r('CAST(coalesce(v, m) AS FLOAT)', 'v', 5)} FROM a JOIN m USING (trace_idx)", 5)(lambda s, d: to_long(projections.align_pad(t := traces(s, d), shifts(t), "avg")))
register("prj_align_crop", SHIFTED + f", c AS (SELECT greatest(0, max(-shift)) AS lo, least(64, min(64 - shift)) AS hi FROM h) SELECT trace_idx, j - lo AS sample_idx, {r('v', 'v')} FROM a, c WHERE j >= lo AND j < hi")(lambda s, d: to_long(projections.align_pad(t := traces(s, d), shifts(t), "crop")))
register("prj_crop_common", SHIFTED + " SELECT CAST(greatest(0, max(-shift)) AS INTEGER) AS start, CAST(least(64, min(64 - shift)) AS INTEGER) AS \"end\" FROM h WHERE trace_idx % 2 = 0")(lambda s, d: projections.common_range(shifts(traces(s, d)), NS))
CROPS = f"WITH {L} SELECT trace_idx, CAST(CASE WHEN k = 0 THEN s - 8 ELSE s - 2 + 8 END AS INTEGER) AS sample_idx, {r('v', 'v')} FROM l, range(0, 2) AS q(k) WHERE (k = 0 AND s >= 8 AND s < 16) OR (k = 1 AND s >= 2 AND s < 12)"
register("prj_crop_ranges", CROPS)(lambda s, d: to_long(projections.crop_ranges(traces(s, d), [(8, 16), (2, 12)])))


def cropped_file(s: SparkSession, d: str) -> DataFrame:
    """The crop, written to a TRS file in the shared folder and read back from it."""
    path = shared_file(s, ".trs")
    trs.write_trs(projections.crop_ranges(traces(s, d), [(8, 16), (2, 12)]), path)
    return to_long(trs.open_trs(s, path).df)


register("snk_trs_crop", CROPS)(cropped_file)
MEANS = f"WITH {L}, m AS (SELECT s, avg(v) AS v FROM l GROUP BY s)"


def means(s: SparkSession, d: str) -> DataFrame:
    return to_long(traces(s, d)).groupBy("sample_idx").agg(F.avg("v").alias("v"))


register("prj_trim", MEANS + f" SELECT s - 3 AS sample_idx, {r('v', 'v')} FROM m WHERE s >= 3 AND s < 59")(lambda s, d: projections.trim(means(s, d), 3, 5, NS))
register("prj_cut", MEANS + f" SELECT CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS sample_idx, {r('v', 'v')} FROM m WHERE NOT ((s >= 4 AND s < 9) OR (s >= 40 AND s < 42))")(lambda s, d: projections.cut(means(s, d), [(40, 42), (4, 9)]))


def unlabelled(t: DataFrame) -> DataFrame:
    """Every fourth trace has lost its label byte."""
    return t.withColumn("data", F.when(F.col("trace_idx") % 4 == 0, F.substring("data", 1, 1)).otherwise(F.col("data")))


register("flt_skip_no_label", f"WITH {T} SELECT CAST(count(*) FILTER (trace_idx % 4 <> 0) AS BIGINT) AS used, CAST(count(*) FILTER (trace_idx % 4 = 0) AS BIGINT) AS skipped FROM t")(lambda s, d: unlabelled(traces(s, d)).agg(F.count_if(F.octet_length("data") > 1).alias("used"), F.count_if(F.octet_length("data") <= 1).alias("skipped")))
register("flt_group_valid", f"WITH {T} SELECT trace_idx, b1 AS grp FROM t WHERE b1 BETWEEN 0 AND 1")(lambda s, d: traces(s, d).withColumn("grp", byte_at(F.col("data"), 1)).where("grp BETWEEN 0 AND 1").select("trace_idx", "grp"))

# --- transforms ---------------------------------------------------------------------------------------


def transform(name: str, step: tx.Transform | list[tx.Transform], select: str, digits: int = 6, more: str = "") -> None:
    steps = step if isinstance(step, list) else [step]
    register(name, f"WITH {L}{more} {select}", digits)(lambda s, d: to_long(tx.run_pipeline(traces(s, d), steps)))


def pointwise(expr: str) -> str:
    return f"SELECT trace_idx, s AS sample_idx, {r(f'CAST({expr} AS FLOAT)', 'v')} FROM l"


MA = f"SELECT trace_idx, s AS sample_idx, {r('CAST(avg(v) OVER (PARTITION BY trace_idx ORDER BY s ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS FLOAT)', 'v', 5)} FROM l"
transform("tx_abs", tx.absolute(), pointwise("abs(v)"))
transform("tx_negate", tx.negate(), pointwise("-v"))
transform("tx_offset", tx.offset(1.5), pointwise("CAST(v AS FLOAT) + CAST(1.5 AS FLOAT)"))
transform("tx_scale", tx.scale(0.25), pointwise("CAST(v AS FLOAT) * CAST(0.25 AS FLOAT)"))
for name in ("tx_moving_avg", "win_moving_avg"):
    transform(name, tx.moving_average(5), MA, 5)
BLOCKS = f"SELECT trace_idx, CAST(s // 10 AS INTEGER) AS sample_idx, {r('CAST(avg(v) AS FLOAT)', 'v', 5)} FROM l WHERE s < 60 GROUP BY trace_idx, s // 10"
for name in ("tx_window_resample", "win_blocks"):
    transform(name, tx.window_resample(10), BLOCKS, 5)
transform("tx_stride_resample", tx.stride_resample(3), f"SELECT trace_idx, s // 3 AS sample_idx, {r('v', 'v')} FROM l WHERE s % 3 = 0")
HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * {s} / {m}))"


def dft(frames: str, size: int, keys: str, pos: str, window: str = "hann") -> str:
    """Common table of windowed sums per frame and bin."""
    w = HANN.format(s=pos, m=size - 1) if window == "hann" else "1.0::DOUBLE"
    return f"""d AS (SELECT {keys}, k, sum(v * {w} * cos(2 * pi() * (({pos} * k) % {size}) / {size}.0::DOUBLE)) AS re,
  sum(-v * {w} * sin(2 * pi() * (({pos} * k) % {size}) / {size}.0::DOUBLE)) AS im FROM {frames}, range(0, {size // 2 + 1}) AS q(k) GROUP BY {keys}, k),
  g AS (SELECT *, sqrt(re * re + im * im) / {size} * CASE WHEN k > 0 AND k < {size // 2} THEN 2 ELSE 1 END AS mag FROM d)"""


transform("tx_fft_mag", tx.fft_magnitude("hann"), f"SELECT trace_idx, CAST(k AS INTEGER) AS sample_idx, {r('CAST(mag AS FLOAT)', 'v', 4)} FROM g", 4, ", " + dft("l", 64, "trace_idx", "s"))
FRAMES = ", f AS (SELECT trace_idx, w, s - 8 * w AS p, v FROM l, range(0, 7) AS z(w) WHERE s >= 8 * w AND s < 8 * w + 16)"
for name in ("tx_stft_mag", "win_frames"):
    transform(name, tx.stft_magnitude(16, 8), f"SELECT trace_idx, CAST(w * 9 + k AS INTEGER) AS sample_idx, {r('CAST(mag AS FLOAT)', 'v', 4)} FROM g", 4, FRAMES + ", " + dft("f", 16, "trace_idx, w", "p"))
register("tx_gauss_noise", None)(lambda s, d: to_long(tx.gaussian_noise(0.1, 7)(traces(s, d))))


def noise_moments(s: SparkSession, d: str) -> DataFrame:
    """Whether each trace's noise, in deviations of the trace times the factor, has a mean near 0 and a deviation near 1."""
    t = traces(s, d)
    noisy = to_long(tx.gaussian_noise(0.1, 7)(t)).withColumnRenamed("v", "w")
    both = to_long(t).join(noisy, ["trace_idx", "sample_idx"]).groupBy("trace_idx").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("w") - F.col("v")).alias("m"), F.stddev_pop(F.col("w") - F.col("v")).alias("e"), F.stddev_pop("v").alias("sd"))
    scale = F.greatest(F.col("sd"), F.lit(1e-8)) * 0.1
    return both.select("trace_idx", "n", (F.abs(F.col("m") / scale) < 0.8).alias("centred"), F.abs(F.col("e") / scale - 1).between(0, 0.5).alias("scaled"))


register("tx_gauss_noise_moments", f"WITH {T} SELECT trace_idx, CAST(64 AS BIGINT) AS n, TRUE AS centred, TRUE AS scaled FROM t")(noise_moments)
PIPE = [tx.absolute(), tx.scale(2.0), tx.window_resample(4)]
transform("prj_pipeline", PIPE, f"SELECT trace_idx, CAST(s // 4 AS INTEGER) AS sample_idx, {r('CAST(avg(CAST(2 * abs(v) AS FLOAT)::DOUBLE) AS FLOAT)', 'v', 5)} FROM l GROUP BY trace_idx, s // 4", 5)
transform("udf_transform", [tx.custom("clip", lambda df: df.withColumn("samples", F.transform("samples", lambda x: F.greatest(x, F.lit(0.0).cast("float")))))], pointwise("greatest(v, 0)"))
register("prj_pipeline_count", f"WITH {T} SELECT trace_idx, CAST((64 - trace_idx % 5) // 4 AS INTEGER) AS n_samples FROM t")(lambda s, d: tx.run_pipeline(ragged(traces(s, d)), PIPE).select("trace_idx", F.size("samples").alias("n_samples")))

# --- traces in chunks: the same results, and all events as one trace ----------------------------------


def chunked(name: str, step: tx.Transform | list[tx.Transform], digits: int = 6) -> None:
    """The query of a transform on chunks of ten samples, held against the SQL of the whole rows."""
    steps = step if isinstance(step, list) else [step]
    register(f"{name}_chunks", SQL[name], digits)(lambda s, d: chunks.to_long(chunks.run_pipeline(chunks.to_chunks(traces(s, d), 10), 10, steps), 10).select("trace_idx", F.col("sample_idx").cast("int").alias("sample_idx"), "v"))


chunked("tx_moving_avg", tx.moving_average(5), 5)
chunked("tx_window_resample", tx.window_resample(10), 5)
chunked("tx_stride_resample", tx.stride_resample(3))
chunked("tx_stft_mag", tx.stft_magnitude(16, 8), 4)
chunked("prj_pipeline", PIPE, 5)
EVENT_CHUNK = 4096
SERIES = "e AS (SELECT CAST(event_id AS BIGINT) AS i, CAST(CAST(value AS FLOAT) AS DOUBLE) AS v FROM events)"
register("tx_moving_avg_events", f"WITH {SERIES} SELECT CAST(0 AS BIGINT) AS trace_idx, i AS sample_idx, {r('CAST(avg(v) OVER (ORDER BY i ROWS BETWEEN 4999 PRECEDING AND CURRENT ROW) AS FLOAT)', 'v', 3)} FROM e", 3)(lambda s, d: chunks.to_long(chunks.run_pipeline(events_chunks(s, d, EVENT_CHUNK), EVENT_CHUNK, [tx.moving_average(5000)]), EVENT_CHUNK))
register("tx_window_resample_events", f"WITH {SERIES} SELECT CAST(0 AS BIGINT) AS trace_idx, i // 700 AS sample_idx, {r('CAST(avg(v) AS FLOAT)', 'v', 3)} FROM e GROUP BY i // 700 HAVING count(*) = 700", 3)(lambda s, d: chunks.to_long(chunks.run_pipeline(events_chunks(s, d, EVENT_CHUNK), EVENT_CHUNK, [tx.window_resample(700)]), EVENT_CHUNK))
register("src_read_samples_events", f"WITH {SERIES} SELECT CAST(0 AS BIGINT) AS trace_idx, i - 5000 AS sample_idx, {r('v', 'v', 4)} FROM e WHERE i >= 5000 AND i < 9500", 4)(lambda s, d: chunks.to_long(chunks.sample_range(events_chunks(s, d, EVENT_CHUNK), EVENT_CHUNK, 5000, 4500), EVENT_CHUNK))

# --- t-test -------------------------------------------------------------------------------------------

WELCH = f"""WITH {L}, u AS (SELECT s, b1 % 2 AS g, v FROM l),
c AS (SELECT s, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS n0, sum(g) AS n1, sum(CASE WHEN g = 0 THEN v ELSE 0 END) AS s0,
  sum(CASE WHEN g = 1 THEN v ELSE 0 END) AS s1, sum(CASE WHEN g = 0 THEN v * v ELSE 0 END) AS q0, sum(CASE WHEN g = 1 THEN v * v ELSE 0 END) AS q1 FROM u GROUP BY s),
e AS (SELECT s, n0, n1, s0 / n0 - s1 / n1 AS dm, greatest(0, (q0 - s0 * s0 / n0) / (n0 - 1)) / n0 AS e0, greatest(0, (q1 - s1 * s1 / n1) / (n1 - 1)) / n1 AS e1 FROM c),
w AS (SELECT s AS sample_idx, CASE WHEN e0 + e1 > 0 THEN dm / sqrt(e0 + e1) ELSE 0 END AS t,
  CASE WHEN e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1) > 1e-300 THEN (e0 + e1) * (e0 + e1) / (e0 * e0 / (n0 - 1) + e1 * e1 / (n1 - 1)) ELSE n0 + n1 - 2 END AS df,
  CAST(n0 AS BIGINT) AS n0, CAST(n1 AS BIGINT) AS n1 FROM e)"""


def parity(s: SparkSession, d: str) -> DataFrame:
    return traces(s, d).withColumn("grp", byte_at(F.col("data"), 1) % 2)


def tstats(s: SparkSession, d: str) -> DataFrame:
    return stats.ttest(parity(s, d))


register("agg_ttest_acc", WELCH + f" SELECT s AS sample_idx, CAST(n0 AS BIGINT) AS n0, {r('s0', 's0')}, {r('q0', 'q0')}, CAST(n1 AS BIGINT) AS n1, {r('s1', 's1')}, {r('q1', 'q1')} FROM c")(lambda s, d: stats.accumulators(parity(s, d)).select("sample_idx", "n0", "s0", "q0", "n1", "s1", "q1"))
register("agg_ttest", WELCH + f" SELECT sample_idx, {r('t', 't')}, {r('df', 'df', 6)}, n0, n1 FROM w")(tstats)


def ragged(t: DataFrame) -> DataFrame:
    """Traces of 60 to 64 samples."""
    return t.withColumn("samples", F.slice("samples", F.lit(1), (64 - F.col("trace_idx") % 5).cast("int")))


# a trace counts once in its group, whichever samples it has
RAGGED = WELCH.replace("SELECT s, b1 % 2 AS g, v FROM l)", "SELECT s, b1 % 2 AS g, v FROM l WHERE s < 64 - trace_idx % 5), z AS (SELECT CAST(sum(1 - b1 % 2) AS BIGINT) AS n0, CAST(sum(b1 % 2) AS BIGINT) AS n1 FROM t)").replace("c AS (SELECT s, sum(CASE WHEN g = 0 THEN 1 ELSE 0 END) AS n0, sum(g) AS n1,", "c AS (SELECT s, any_value(n0) AS n0, any_value(n1) AS n1,").replace("FROM u GROUP BY s)", "FROM u, z GROUP BY s)")
register("agg_ttest_ragged", RAGGED + f" SELECT sample_idx, {r('t', 't', 5)}, {r('df', 'df', 5)}, n0, n1 FROM w", 5)(lambda s, d: stats.ttest(ragged(parity(s, d))))
register("agg_ttest_byte", WELCH.replace("b1 % 2 AS g", "CASE WHEN b1 <> 0 THEN 1 ELSE 0 END AS g") + f" SELECT sample_idx, {r('t', 't')}, {r('df', 'df', 6)}, n0, n1 FROM w")(lambda s, d: stats.ttest(traces(s, d).withColumn("grp", (byte_at(F.col("data"), 1) != 0).cast("int"))))
register("agg_ttest_df", WELCH + f" SELECT sample_idx, {r('df', 'df', 5)} FROM w", 5)(lambda s, d: tstats(s, d).select("sample_idx", "df"))
register("agg_ttest_counts", f"WITH {T} SELECT CAST(sum(CASE WHEN b1 % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, CAST(sum(b1 % 2) AS BIGINT) AS n1 FROM t")(lambda s, d: stats.group_counts(parity(s, d)))
register("agg_median_df", WELCH + f" SELECT {r('df', 'median_df', 5)} FROM (SELECT df, row_number() OVER (ORDER BY df) AS k FROM w) WHERE k = 33", 5)(lambda s, d: stats.median_df(tstats(s, d)))
register("flt_threshold", WELCH + f" SELECT sample_idx, {r('t', 't')} FROM w WHERE abs(t) >= 1.5")(lambda s, d: stats.over_threshold(tstats(s, d), 1.5).select("sample_idx", "t"))
ROOT = "sqrt(-2 * ln(p))"
NUM, DEN = fn.NORMAL_NUMERATOR, fn.NORMAL_DENOMINATOR
Q = f"({ROOT} - ({NUM[0]} + {NUM[1]} * {ROOT} + {NUM[2]} * (-2 * ln(p))) / (1 + {DEN[0]} * {ROOT} + {DEN[1]} * (-2 * ln(p)) + {DEN[2]} * pow({ROOT}, 3)))"
TH = f"z AS (SELECT df, (1 - pow(1 - 0.001::DOUBLE, 1.0 / 64)) / 2 AS p FROM w), y AS (SELECT df, {Q} AS q FROM z), th AS (SELECT df, CASE WHEN df >= 200 THEN q ELSE q + (pow(q, 3) + q) / 4 / df + (5 * pow(q, 5) + 16 * pow(q, 3) + 3 * q) / 96 / (df * df) END AS threshold FROM y)"
for name in ("fn_threshold", "fn_inv_t"):
    register(name, WELCH.replace("SELECT s AS sample_idx, CASE WHEN e0 + e1", "SELECT s AS sample_idx, CASE WHEN e0 + e1") + f", m AS (SELECT df FROM (SELECT df, row_number() OVER (ORDER BY df) AS k FROM w) WHERE k = 33), {TH.replace('FROM w)', 'FROM m)')} SELECT {r('df', 'median_df', 5)}, CAST(64 AS BIGINT) AS n_samples, {r('threshold', 'threshold', 5)} FROM th", 5)(lambda s, d: stats.ttest_threshold(tstats(s, d)))
register("fn_inv_norm", f"WITH {T}, a AS (SELECT trace_idx, (CAST(b0 AS DOUBLE) + 0.5::DOUBLE) / 256 AS p0 FROM t), b AS (SELECT trace_idx, p0, CASE WHEN p0 < 0.5::DOUBLE THEN p0 ELSE 1 - p0 END AS p FROM a) SELECT trace_idx, {r(f'CASE WHEN p0 < 0.5::DOUBLE THEN -{Q} ELSE {Q} END', 'z')} FROM b")(lambda s, d: traces(s, d).select("trace_idx", fn.inv_norm((byte_at(F.col("data"), 0).cast("double") + 0.5) / 256).alias("z")))
register("fn_sidak", f"WITH {T} SELECT trace_idx, {r('1 - pow(1 - 0.05::DOUBLE, 1.0::DOUBLE / (b0 + 1))', 'alpha')} FROM t")(lambda s, d: traces(s, d).select("trace_idx", fn.sidak(F.lit(0.05), (byte_at(F.col("data"), 0) + 1).cast("double")).alias("alpha")))
register("fn_nu_approx", f"WITH {T}, n AS (SELECT sum(CASE WHEN b1 % 2 = 0 THEN 1 ELSE 0 END)::DOUBLE AS a, sum(b1 % 2)::DOUBLE AS b FROM t) SELECT {r('pow(1 / a + 1 / b, 2) / (1 / a / a / (a - 1) + 1 / b / b / (b - 1))', 'nu', 4)} FROM n", 4)(lambda s, d: stats.group_counts(parity(s, d)).select(fn.nu_approx(F.col("n0").cast("double"), F.col("n1").cast("double")).alias("nu")))

# --- signal-to-noise ----------------------------------------------------------------------------------


def snr_sql(cls: str) -> str:
    return f"""WITH {L}, c AS (SELECT s, {cls} AS k, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS var FROM l GROUP BY s, {cls}),
  g AS (SELECT *, sum(n) OVER (PARTITION BY s) AS nn, sum(n * m) OVER (PARTITION BY s) / sum(n) OVER (PARTITION BY s) AS mm FROM c)
  SELECT s AS sample_idx, {r('CASE WHEN sum(CASE WHEN n > 1 THEN n * var ELSE 0 END) > 0 THEN sum(n * (m - mm) * (m - mm)) / sum(CASE WHEN n > 1 THEN n * var ELSE 0 END) ELSE 0 END', 'snr')} FROM g GROUP BY s"""


def classed(s: SparkSession, d: str, mode: str) -> DataFrame:
    return traces(s, d).withColumn("cls", fn.byte_class(byte_at(F.col("data"), 0), mode))


register("agg_snr", snr_sql("b1"))(lambda s, d: stats.snr(traces(s, d).withColumn("cls", byte_at(F.col("data"), 1)), 256))
register("agg_snr_hw", snr_sql(BITS.format("b0")))(lambda s, d: stats.snr(classed(s, d, "hw"), 9))
register("agg_snr_acc", f"WITH {L} SELECT s AS sample_idx, b1 AS cls, CAST(count(*) AS BIGINT) AS n, {r('sum(v)', 's')}, {r('sum(v * v)', 'q')} FROM l GROUP BY s, b1")(lambda s, d: stats.snr_sums(to_long(traces(s, d).withColumn("cls", byte_at(F.col("data"), 1)), keep=("cls",)), 256).drop("d"))
register("agg_snr_counts", f"WITH {T} SELECT b1 AS cls, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY b1")(lambda s, d: stats.class_counts(traces(s, d).withColumn("cls", byte_at(F.col("data"), 1)), 256))
register(
    "agg_snr_ragged",
    f"""WITH {L}, k AS (SELECT b1 AS k, count(*)::DOUBLE AS n FROM t GROUP BY b1), c AS (SELECT s, b1 AS k, sum(v) AS x, sum(v * v) AS q FROM l WHERE s < 64 - trace_idx % 5 GROUP BY s, b1),
  c2 AS (SELECT g.s, k.n, coalesce(x, 0) AS x, coalesce(q, 0) AS q FROM (SELECT DISTINCT s FROM l) g CROSS JOIN k LEFT JOIN c ON c.s = g.s AND c.k = k.k),
  m AS (SELECT *, sum(x) OVER (PARTITION BY s) / sum(n) OVER (PARTITION BY s) AS mm FROM c2)
  SELECT s AS sample_idx, {r('sum(n * (x / n - mm) * (x / n - mm)) / sum(CASE WHEN n > 1 THEN n * (q - x * x / n) / (n - 1) ELSE 0 END)', 'snr')} FROM m GROUP BY s""",
)(lambda s, d: stats.snr(ragged(traces(s, d)).withColumn("cls", byte_at(F.col("data"), 1)), 256))
register("agg_static_snr", f"WITH {L} SELECT s AS sample_idx, {r('CASE WHEN stddev_samp(v) > 0 THEN abs(avg(v)) / stddev_samp(v) ELSE 0 END', 'snr')} FROM l GROUP BY s")(lambda s, d: stats.static_snr(to_long(traces(s, d))))
register("fn_class_mode", f"WITH {T} SELECT trace_idx, b0 AS raw, CAST({BITS.format('b0')} AS INTEGER) AS hw, CAST({BOX}[b0 + 1] AS INTEGER) AS sbox, CAST({BITS.format(BOX + '[b0 + 1]')} AS INTEGER) AS hw_sbox FROM t")(lambda s, d: traces(s, d).withColumn("b", byte_at(F.col("data"), 0)).select("trace_idx", *[fn.byte_class(F.col("b"), m).cast("int").alias("raw" if m == "byte" else m) for m in ("byte", "hw", "sbox", "hw_sbox")]))
for name in ("fn_sbox", "jn_sbox"):
    register(name, f"WITH {T} SELECT trace_idx, CAST({BOX}[xor(b0, 43) + 1] AS INTEGER) AS y FROM t")(lambda s, d: traces(s, d).select("trace_idx", fn.sbox(byte_at(F.col("data"), 0), 43).cast("int").alias("y")))
for name in ("fn_hamming_weight", "fn_leak_hw"):
    register(name, f"WITH {T} SELECT trace_idx, CAST({BITS.format('xor(b0, 90)')} AS INTEGER) AS hw FROM t")(lambda s, d: traces(s, d).select("trace_idx", fn.hamming_weight(byte_at(F.col("data"), 0).bitwiseXOR(F.lit(90))).cast("int").alias("hw")))
register("agg_trace_stats", f"WITH {L} SELECT trace_idx, {r('avg(v)', 'mean')}, {r('stddev_pop(v)', 'sd')} FROM l GROUP BY trace_idx")(lambda s, d: stats.trace_stats(to_long(traces(s, d))))
register("agg_trace_stats_events", f"WITH {EVENTS} SELECT trace_idx, {r('avg(v)', 'mean', 4)}, {r('stddev_pop(v)', 'sd', 4)} FROM l GROUP BY trace_idx", 4)(lambda s, d: stats.trace_stats(events_long(s, d)))

# --- CPA ----------------------------------------------------------------------------------------------

CPA = f"""WITH {L}, m AS (SELECT CAST(h AS INTEGER) AS h, CAST(b AS INTEGER) AS b, CAST({BITS.format('xor(h, b)')} AS DOUBLE) AS y FROM range(0, 256) AS p(h), range(0, 256) AS q(b)),
a AS (SELECT b0, s, count(*) AS c, sum(v) AS sv, sum(v * v) AS qv FROM l GROUP BY b0, s),
j AS (SELECT h, s, sum(c) AS n, sum(sv) AS sx, sum(qv) AS sxx, sum(c * y) AS sy, sum(c * y * y) AS syy, sum(sv * y) AS sxy FROM a JOIN m ON a.b0 = m.b GROUP BY h, s),
k AS (SELECT h AS hypothesis, s AS sample_idx, (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) AS corr FROM j)"""


def cpa_result(s: SparkSession, d: str) -> DataFrame:
    return cpa.cpa(traces(s, d), cpa.hamming_weight_model)


for name in ("agg_cpa", "jn_hypothesis"):
    register(name, CPA + f" SELECT hypothesis, sample_idx, {r('corr', 'corr')} FROM k")(cpa_result)
OFFSET = CPA.replace("FROM l GROUP BY b0, s", "FROM (SELECT b0, s, u - avg(u) OVER (PARTITION BY s) AS v FROM (SELECT b0, s, CAST(CAST(v AS FLOAT) + CAST(30000 AS FLOAT) AS DOUBLE) AS u FROM l)) GROUP BY b0, s")
register("agg_cpa_offset", OFFSET + f" SELECT hypothesis, sample_idx, {r('corr', 'corr')} FROM k")(lambda s, d: cpa.cpa(tx.offset(30000.0)(traces(s, d)), cpa.hamming_weight_model))
RANKED = CPA + ", z AS (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY round(abs(corr), 9) DESC, sample_idx) AS o FROM k)"


def ranked(s: SparkSession, d: str) -> DataFrame:
    return cpa.rank_hypotheses(cpa_result(s, d).withColumn("corr", F.round("corr", 9)))


register("top_cpa_rank", RANKED + f" SELECT hypothesis, {r('abs(corr)', 'peak')}, sample_idx FROM z WHERE o = 1")(lambda s, d: ranked(s, d).select("hypothesis", "peak", "sample_idx"))
register("top_cpa_16", RANKED + f" SELECT hypothesis, printf('0X%02X', hypothesis) AS name, {r('abs(corr)', 'peak')} FROM z WHERE o = 1 ORDER BY round(abs(corr), 9) DESC, hypothesis LIMIT 16")(lambda s, d: cpa.top_hypotheses(cpa_result(s, d).withColumn("corr", F.round("corr", 9))).select("hypothesis", "name", "peak"))
register("udf_model_eval", CPA + f" SELECT hypothesis, sample_idx, {r('corr', 'corr')} FROM k")(lambda s, d: cpa.cpa_user_model(traces(s, d), cpa.compile_model(cpa.MODEL_TEMPLATE)))
WHOLE_MODEL = """import numpy as np

def get_leakages(data, keys, hypothesis):
    # the distance of each byte from the mean of all traces
    y = (data[:, 0] ^ hypothesis).astype(float)
    return np.abs(y - y.mean())
"""
register(
    "udf_model_eval_whole",
    f"""WITH {L}, hyp AS (SELECT CAST(h AS INTEGER) AS h FROM range(0, 256) AS q(h)),
  y AS (SELECT trace_idx, h, CAST(CAST(abs(xor(b0, h) - avg(xor(b0, h)) OVER (PARTITION BY h)) AS FLOAT) AS DOUBLE) AS y FROM t, hyp)
  SELECT h AS hypothesis, s AS sample_idx, {r('corr(y, v)', 'corr', 5)} FROM y JOIN l USING (trace_idx) GROUP BY h, s""",
    5,
)(lambda s, d: cpa.cpa_user_model(traces(s, d), cpa.compile_model(WHOLE_MODEL), row_local=False))
register("udf_model_boiler", CPA.replace(BITS.format("xor(h, b)"), BITS.format(BOX + "[xor(h, b) + 1]"))  + f" SELECT hypothesis, sample_idx, {r('corr', 'corr')} FROM k")(lambda s, d: cpa.cpa(traces(s, d), cpa.sbox_model))
register("prj_matrix_rows", CPA + f" SELECT hypothesis AS trace_idx, sample_idx, {r('CAST(corr AS FLOAT)', 'v', 5)} FROM k", 5)(lambda s, d: to_long(projections.matrix_rows(cpa_result(s, d), "hypothesis", "sample_idx", "corr")))

# --- correlation matrices -----------------------------------------------------------------------------

XC = f"""WITH {L}, g AS (SELECT a.s AS i, b.s AS j, avg(a.v * b.v) AS xy, avg(a.v) AS mx, avg(b.v) AS my, var_pop(a.v) AS vx, var_pop(b.v) AS vy FROM l a JOIN l b ON a.trace_idx = b.trace_idx GROUP BY a.s, b.s),
x AS (SELECT i, j, CASE WHEN vx > 1e-30 AND vy > 1e-30 THEN (xy - mx * my) / sqrt(vx * vy) ELSE 0 END AS corr FROM g)"""


def matrix(s: SparkSession, d: str) -> DataFrame:
    return xcorr.correlation(traces(s, d), NS)


for name, f in (("agg_xcorr_base", matrix), ("agg_xcorr_dual", lambda s, d: xcorr.correlation_dual(traces(s, d), NS)), ("agg_xcorr_naive", lambda s, d: xcorr.rectangle(traces(s, d), (0, NS), (0, NS))), ("jn_gram", matrix)):
    register(name, XC + f" SELECT i, j, {r('corr', 'corr')} FROM x")(f)
register("agg_xcorr_stride", XC + f" SELECT i // 4 AS i, j // 4 AS j, {r('corr', 'corr')} FROM x WHERE i % 4 = 0 AND j % 4 = 0")(lambda s, d: xcorr.correlation(traces(s, d), NS, 4))
register("agg_xcorr_stats", f"WITH {L} SELECT s AS sample_idx, CAST(count(*) AS BIGINT) AS n, {r('avg(v)', 'mean')}, {r('var_pop(v)', 'var')} FROM l GROUP BY s")(lambda s, d: xcorr.sample_moments(to_long(traces(s, d))))
register("agg_xcorr_mp", None)(lambda s, d: xcorr.correlation_cleaned(traces(s, d), NS)[0])
for name in ("agg_two_window", "jn_two_window"):
    register(name, XC + f" SELECT i - 8 AS search, j - 30 AS ref, {r('corr', 'corr')} FROM x WHERE i >= 8 AND i < 24 AND j >= 30 AND j < 40")(lambda s, d: xcorr.two_windows(traces(s, d), (30, 10), (8, 16)))
register("flt_cell", XC + f" SELECT i, j, {r('corr', 'corr')} FROM x WHERE i = 3 AND j = 11")(lambda s, d: matrix(s, d).where("i = 3 AND j = 11"))


def matrix_estimate(s: SparkSession, d: str) -> DataFrame:
    """The size of the correlation matrix of the table's longest trace, every fifth sample."""
    n = traces(s, d).agg(F.max(F.size("samples"))).first()[0]
    return s.createDataFrame([tuple(xcorr.estimate(n, 5).values())], "side long, bytes long")


register("fn_mem_estimate", f"WITH {T}, m AS (SELECT CAST((max(len(x)) + 4) // 5 AS BIGINT) AS side FROM t) SELECT side, CAST(4 * side * side AS BIGINT) AS bytes FROM m")(matrix_estimate)
register("agg_color_range", XC + f" SELECT {r('-max(abs(corr))', 'lo')}, {r('max(abs(corr))', 'hi')} FROM x")(lambda s, d: stats.color_range(matrix(s, d), "corr"))
register("agg_clip_range", XC + f", o AS (SELECT corr, row_number() OVER (ORDER BY corr) - 1 AS k, count(*) OVER () AS n FROM x) SELECT {r('min(CASE WHEN k = floor(0.02::DOUBLE * (n - 1)) THEN corr END)', 'lo')}, {r('min(CASE WHEN k = floor(0.98::DOUBLE * (n - 1)) THEN corr END)', 'hi')} FROM o")(lambda s, d: stats.clip_range(matrix(s, d), "corr", 0.02))

# --- statistics of shifted traces behind a pipeline ---------------------------------------------------

SHIFT_PIPE = (tx.absolute(), tx.scale(2.0))


def of_shifted(sql: str) -> str:
    """The same SQL over the traces after shifts, absolute values and doubling."""
    moved = f"""WITH {L}, h0 AS (SELECT trace_idx, b0, b1, CASE WHEN trace_idx % 2 = 0 THEN trace_idx % 7 - 3 ELSE 0 END AS shift FROM t),
  l2 AS (SELECT h0.trace_idx, b0, b1, CAST(z.s AS INTEGER) AS s, 2 * abs(coalesce(o.v, 0)) AS v FROM h0 CROSS JOIN range(0, 64) AS z(s)
    LEFT JOIN (SELECT trace_idx AS i, s AS p, v FROM l) o ON o.i = h0.trace_idx AND o.p = z.s + h0.shift)"""
    rest = sql.removeprefix(f"WITH {L}")
    return moved + rest.replace("FROM l)", "FROM l2)").replace("FROM l GROUP", "FROM l2 GROUP").replace("FROM l a JOIN l b", "FROM l2 a JOIN l2 b")


register("agg_ttest_shift", of_shifted(WELCH) + f" SELECT sample_idx, {r('t', 't')}, {r('df', 'df', 6)}, n0, n1 FROM w")(lambda s, d: stats.ttest(t := parity(s, d), shifts=shifts(t), pipeline=SHIFT_PIPE))
register("agg_cpa_shift", of_shifted(CPA) + f" SELECT hypothesis, sample_idx, {r('corr', 'corr')} FROM k")(lambda s, d: cpa.cpa(t := traces(s, d), cpa.hamming_weight_model, shifts=shifts(t), pipeline=SHIFT_PIPE))
register("agg_xcorr_shift", of_shifted(XC) + f" SELECT i, j, {r('corr', 'corr')} FROM x")(lambda s, d: xcorr.correlation(t := traces(s, d), NS, shifts=shifts(t), pipeline=SHIFT_PIPE))

# --- spectra ------------------------------------------------------------------------------------------

SPEC = f"WITH {L}, {dft('l', 64, 'trace_idx', 's')}"


register("agg_fft_avg", SPEC + f" SELECT CAST(k AS INTEGER) AS bin, {r('avg(mag)', 'mean')}, {r('min(mag)', 'lo')}, {r('max(mag)', 'hi')} FROM g GROUP BY k")(lambda s, d: stats.mean_spectrum(traces(s, d), NS))
register("fn_db", SPEC + f" SELECT CAST(k AS INTEGER) AS bin, {r('avg(CASE WHEN mag > 1e-10 THEN 20 * log10(mag) ELSE -200 END)', 'mean', 4)} FROM g GROUP BY k", 4)(lambda s, d: stats.mean_spectrum(traces(s, d), NS, "db").select("bin", "mean"))
register("fn_phase", SPEC + f" SELECT CAST(k AS INTEGER) AS bin, {r('avg(atan2(im, re))', 'mean', 4)} FROM g WHERE k BETWEEN 1 AND 31 GROUP BY k", 4)(lambda s, d: stats.mean_spectrum(traces(s, d), NS, "phase").where("bin BETWEEN 1 AND 31").select("bin", "mean"))
register("agg_fft_axis", f"WITH {L} SELECT s AS bin, {r('avg(v)', 'v')}, {r('s / 0.001::DOUBLE / 64', 'frequency')} FROM l GROUP BY s")(lambda s, d: stats.frequency_axis(means(s, d).withColumnRenamed("sample_idx", "bin"), 0.001, NS))
register("fn_window_coef", f"WITH {L} SELECT trace_idx, s AS sample_idx, {r('v * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * s / 63))', 'hann')}, {r('v * (0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * s / 63))', 'hamming')}, {r('v * (0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * s / 63) + 0.08::DOUBLE * cos(4 * pi() * s / 63))', 'blackman')} FROM l")(lambda s, d: to_long(traces(s, d)).select("trace_idx", "sample_idx", *[(F.col("v") * fn.window_coefficient(w, F.col("sample_idx"), F.lit(64))).alias(w) for w in ("hann", "hamming", "blackman")]))

# --- alignment ----------------------------------------------------------------------------------------

PEAK = f"""WITH {L}, p AS (SELECT s AS p FROM l WHERE trace_idx = 0 AND s >= 16 AND s < 48 ORDER BY v DESC, s LIMIT 1),
k AS (SELECT trace_idx, s, row_number() OVER (PARTITION BY trace_idx ORDER BY v DESC, s) AS o FROM l, p WHERE s >= greatest(0, p - 8) AND s <= least(63, p + 8))"""
for name in ("aln_peak", "arg_peak", "jn_ref_peak"):
    register(name, PEAK + " SELECT trace_idx, CAST(CASE WHEN trace_idx = 0 THEN 0 ELSE s - p END AS INTEGER) AS shift FROM k, p WHERE o = 1")(lambda s, d: align.align_by_peak(traces(s, d), 0, (16, 48), 8))
NCC = f"""WITH {L}, w AS (SELECT s - 24 AS m, v - avg(v) OVER () AS y FROM l WHERE trace_idx = 0 AND s >= 24 AND s < 40),
c AS (SELECT l.trace_idx, lag, m, l.v, w.y, l.v - avg(l.v) OVER (PARTITION BY l.trace_idx, lag) AS x FROM range(16, 33) AS q(lag), w, l WHERE l.s = lag + m),
n AS (SELECT trace_idx, lag, CAST(CASE WHEN sum(x * x) > 0 THEN sum(x * y) / (sqrt(sum(y * y)) * sqrt(sum(x * x))) ELSE 0 END AS FLOAT) AS ncc FROM c GROUP BY trace_idx, lag),
o AS (SELECT trace_idx, lag, row_number() OVER (PARTITION BY trace_idx ORDER BY ncc DESC, lag) AS k FROM n)"""
for name in ("aln_xcorr", "jn_ref_template"):
    register(name, NCC + " SELECT trace_idx, CAST(CASE WHEN trace_idx = 0 THEN 0 ELSE lag - 24 END AS INTEGER) AS shift FROM o WHERE k = 1")(lambda s, d: align.align_by_correlation(traces(s, d), 0, (24, 40), 8))
register("aln_manual", SHIFTED + " SELECT trace_idx, CAST(shift - CASE WHEN trace_idx = 4 THEN 2 ELSE 0 END AS INTEGER) AS shift FROM h WHERE trace_idx % 2 = 0")(lambda s, d: align.manual_shift(shifts(traces(s, d)), 4, 2))

# --- display tables -----------------------------------------------------------------------------------

register("agg_viz_minmax", f"WITH {L} SELECT trace_idx, CAST(floor((s - 4) * 10 / 50.0) AS INTEGER) AS pixel, {r('min(v)', 'lo')}, {r('max(v)', 'hi')} FROM l WHERE s >= 4 AND s < 54 GROUP BY 1, 2")(lambda s, d: display.pixel_extremes(to_long(traces(s, d)), 4, 50, 10))
register("viz_startup_skip", f"WITH {L} SELECT trace_idx, s AS sample_idx, {r('v', 'v')} FROM l WHERE s >= 4")(lambda s, d: to_long(traces(s, d)).where(F.col("sample_idx") >= max(t.startup for t in [tx.absolute(), tx.moving_average(5)])))
register("viz_heat_sample", XC + f", p AS (SELECT CAST(x AS INTEGER) AS px, CAST(y AS INTEGER) AS py, CAST(least(47, 8 + floor((x + 0.5) * 40 / 10)) AS INTEGER) AS j, CAST(least(31, floor((y + 0.5) * 32 / 12)) AS INTEGER) AS i FROM range(0, 10) AS a(x), range(0, 12) AS b(y)) SELECT px AS x, py AS y, {r('corr', 'value')} FROM p JOIN x USING (i, j)")(lambda s, d: display.sampled_matrix(matrix(s, d), (0, 32), (8, 48), 10, 12))
register("agg_yrange", f"WITH {L} SELECT {r('min(v) - (max(v) - min(v)) * 0.05::DOUBLE', 'lo')}, {r('max(v) + (max(v) - min(v)) * 0.05::DOUBLE', 'hi')} FROM l")(lambda s, d: stats.y_range(to_long(traces(s, d))))
register("win_sticky_range", f"WITH {L} SELECT trace_idx, s AS sample_idx, {r('min(v) OVER w', 'lo')}, {r('max(v) OVER w', 'hi')} FROM l WINDOW w AS (PARTITION BY trace_idx ORDER BY s ROWS UNBOUNDED PRECEDING)")(lambda s, d: projections.sticky_range(to_long(traces(s, d))))
register("win_measure", f"WITH {L}, m AS (SELECT trace_idx, s AS sample_idx, lead(s) OVER w - s AS d_sample, lead(v) OVER w - v AS v FROM l WHERE s % 16 = 3 WINDOW w AS (PARTITION BY trace_idx ORDER BY s)) SELECT trace_idx, sample_idx, d_sample, {r('v', 'd_value')} FROM m WHERE d_sample IS NOT NULL")(lambda s, d: projections.measure(to_long(traces(s, d)).where("sample_idx % 16 = 3")))
K = "exp(-0.5::DOUBLE * (k / 1.5::DOUBLE) * (k / 1.5::DOUBLE))"
register("win_gauss_blur", XC + f""", q AS (SELECT k, {K} / sum({K}) OVER () AS w FROM range(-5, 6) AS z(k)),
  h AS (SELECT x.i, t AS j, sum(x.corr * q.w) AS c FROM range(0, 64) AS z(t), q, x WHERE x.j = least(63, greatest(0, t + k)) GROUP BY x.i, t),
  u AS (SELECT t AS i, h.j, sum(h.c * q.w) AS c FROM range(0, 64) AS z(t), q, h WHERE h.i = least(63, greatest(0, t + k)) GROUP BY t, h.j)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {r('c', 'value')} FROM u""")(lambda s, d: display.gaussian_blur(matrix(s, d), 1.5, NS, NS))
register("top_nearest_trace", f"WITH {L} SELECT trace_idx, {r('v', 'v')}, {r('abs(v - 0.1::DOUBLE)', 'distance')} FROM l WHERE s = 7 ORDER BY abs(v - 0.1::DOUBLE), trace_idx LIMIT 1")(lambda s, d: display.nearest_trace(to_long(traces(s, d)), 7, 0.1))
register("lim_preview", f"WITH {T} SELECT trace_idx, b0 FROM t ORDER BY trace_idx LIMIT 8")(lambda s, d: display.preview(traces(s, d), 8).select("trace_idx", byte_at(F.col("data"), 0).alias("b0")))
V = "CAST(b0 AS DOUBLE) / 255"


def places(s: SparkSession, d: str) -> DataFrame:
    return traces(s, d).select("trace_idx", (byte_at(F.col("data"), 0).cast("double") / 255).alias("x"))


def column(name: str, sql: str, f: Callable[[Column], Column], out: str, digits: int = 6) -> None:
    register(name, f"WITH {T} SELECT trace_idx, {sql} FROM t", digits)(lambda s, d: places(s, d).select("trace_idx", f(F.col("x")).alias(out)))


column("fn_heat_abs", r(f"abs({V} - 0.5::DOUBLE)", "y"), lambda x: F.abs(x - F.lit(0.5)), "y")
column("fn_heat_gamma", r(f"0.2::DOUBLE + pow(least(1, greatest(0, ({V} - 0.2::DOUBLE) / 0.6::DOUBLE)), 0.5::DOUBLE) * 0.6::DOUBLE", "y", 5), lambda x: fn.heat_gamma(x, F.lit(0.2), F.lit(0.8), 0.5), "y", 5)
column("fn_heat_binary", f"CASE WHEN {V} >= 0.5::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y", lambda x: fn.heat_binary(x, 0.5), "y")


def palette_sql(name: str) -> str:
    """Packed RGB by linear pieces between a palette's stops."""
    stops, x = fn.PALETTES[name], f"({V})"
    pieces = [(p, q, [f"CAST(floor({i}::DOUBLE + {j - i}::DOUBLE * (({x} - {p}::DOUBLE) / {q - p!r}::DOUBLE)) AS INTEGER)" for i, j in zip(a, b, strict=True)]) for (p, *a), (q, *b) in zip(stops, stops[1:], strict=False)]
    cases = " ".join(f"WHEN {x} <= {q}::DOUBLE THEN {c[0]} * 65536 + {c[1]} * 256 + {c[2]}" for _, q, c in pieces)
    return f"CAST(CASE {cases} END AS INTEGER) AS {name}"


register("fn_colormap", f"WITH {T} SELECT trace_idx, {', '.join(map(palette_sql, fn.PALETTES))} FROM t")(lambda s, d: places(s, d).select("trace_idx", *[fn.colormap(F.col("x"), p).alias(p) for p in fn.PALETTES]))
register("fn_pixel", f"WITH {T} SELECT trace_idx, CAST(floor((b0 - 10) * 300 / 77.0) AS BIGINT) AS pixel, CAST(10 + floor(b0 * 77 / 300.0) AS BIGINT) AS sample FROM t")(lambda s, d: traces(s, d).withColumn("b", byte_at(F.col("data"), 0).cast("long")).select("trace_idx", fn.sample_to_pixel(F.col("b"), 10, 77, 300).alias("pixel"), fn.pixel_to_sample(F.col("b"), 10, 77, 300).alias("sample")))



def zoomed(s: SparkSession, d: str) -> DataFrame:
    """A view of all events but the first hundred as one trace, from the pyramid of their chunks."""
    t = events_chunks(s, d, EVENT_CHUNK)
    n = s.read.parquet(f"{d}/events.parquet").count()
    return pyramid.view(pyramid.build(t, EVENT_CHUNK, n, 64), t, EVENT_CHUNK, 100, n - 100, 37, 64)


register(
    "agg_viz_minmax_events",
    f"""WITH {SERIES}, n AS (SELECT count(*) - 100 AS n FROM e)
  SELECT CAST(0 AS BIGINT) AS trace_idx, CAST((i - 100) * 37 // n AS INTEGER) AS pixel, {r('min(v)', 'lo')}, {r('max(v)', 'hi')} FROM e, n WHERE i >= 100 GROUP BY (i - 100) * 37 // n""",
)(zoomed)

# --- bytes and labels ---------------------------------------------------------------------------------


def labels(name: str, sql: str, f: Callable[[Column], Column], out: str, kind: str = "int") -> None:
    register(name, f"WITH {T} SELECT trace_idx, {sql} FROM t")(lambda s, d: traces(s, d).select("trace_idx", f(F.col("data")).cast(kind).alias(out)))


labels("fn_read_int", "CAST(b0 * 256 + b1 AS BIGINT) AS y", lambda b: fn.read_int(b, 0, 8, True), "y", "long")
labels("fn_label_raw", "CAST(b0 + 256 * b1 AS BIGINT) AS y", lambda b: fn.label_raw(b, 0, 2), "y", "long")
labels("fn_label_hw", f"CAST({BITS.format('b0')} + {BITS.format('b1')} AS INTEGER) AS y", lambda b: fn.label_hw(b, 0, 2), "y")
labels("fn_label_bit", "CAST((b0 >> 3) & 1 AS INTEGER) AS y", lambda b: fn.label_bit(b, 0, 3), "y")
labels("fn_label_bitrange", "CAST((b0 >> 2) & 7 AS INTEGER) AS y", lambda b: fn.label_bit_range(b, 0, 2, 4), "y")
labels("fn_param_decode", "CAST(CASE WHEN b0 >= 128 THEN b0 - 256 ELSE b0 END AS BIGINT) AS y", lambda b: fn.param_value(b, 0, 1, 2), "y", "long")
labels("fn_hex", "printf('%02x%02x', b0, b1) AS y", fn.hex_dump, "y", "string")
register("fn_crc32", None)(lambda s, d: traces(s, d).select("trace_idx", F.crc32("data").alias("crc")))


def dataset(s: SparkSession, d: str) -> DataFrame:
    """Traces and two label arrays, written to an archive in the shared folder and read back from it."""
    path = shared_file(s, ".npz")
    npy.write_traces_npz(traces(s, d), path, {"raw": fn.label_raw(F.col("data"), 0, 1), "hw": fn.label_hw(F.col("data"), 0)})
    return npy.open_npz(s, path).df.select("trace_idx", F.get("samples", F.lit(0)).cast("double").alias("first"), F.col("raw").cast("int").alias("raw"), F.col("hw").cast("int").alias("hw"))


register("snk_dataset", f"WITH {T} SELECT trace_idx, {r('x[1]', 'first')}, CAST(b0 AS INTEGER) AS raw, CAST({BITS.format('b0')} AS INTEGER) AS hw FROM t")(dataset)
