"""Correlation of samples with leakage models, by hypothesis.

A model that depends on one data byte is summed by (byte, sample) first: at most 256 rows per
sample meet the hypotheses, whatever the number of traces.  Other models are evaluated trace by
trace in an Arrow kernel; sums of products are packed tiles of hypotheses by samples (``operators.tiles``).
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalar import SBOX
from tracewright.model import byte_at, to_long
from tracewright.operators.projections import prepared
from tracewright.operators.tiles import SIDE, TILE, Moments, added, correlation_cells, dense, runs, tile_batch

MAX_HYPOTHESES = 65_536


def pearson(n: Column, sx: Column, sxx: Column, sy: Column, syy: Column, sxy: Column, centre: Column) -> Column:
    """From sums of centred samples x and model values y; 0 where either variance is not positive. Deviations
    below 1e-12 of the value that samples were centred on are rounding: float32 samples cannot differ by so little."""
    vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
    good = (vx > 0) & (vx > 1e-24 * centre * centre) & (vy > 1e-12 * syy / n)
    return F.when(good, (sxy / n - sx / n * sy / n) / F.sqrt(F.when(good, vx * vy))).otherwise(F.lit(0.0))


def hamming_weight_model(byte: Column, hypothesis: Column) -> Column:
    return F.bit_count(byte.bitwiseXOR(hypothesis)).cast("double")


def sbox_model(byte: Column, hypothesis: Column) -> Column:
    return F.bit_count(F.get(F.array(*[F.lit(x) for x in SBOX]), byte.bitwiseXOR(hypothesis).bitwiseAND(F.lit(255)).cast("int"))).cast("double")


def cpa(traces: DataFrame, model: Callable[[Column, Column], Column], n_hypotheses: int = 256, byte: int = 0, start: int = 0, count: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """hypothesis, sample_idx, corr for a model of one byte. Traces that miss a sample count with 0. Range, shifts and
    pipeline as in ``projections.prepared``."""
    if not 1 <= n_hypotheses <= MAX_HYPOTHESES:
        raise ValueError(f"hypotheses must be 1 to {MAX_HYPOTHESES}")
    known = prepared(traces.where(F.octet_length("data") > byte), start, count, shifts, pipeline).withColumn("b", byte_at(F.col("data"), byte))
    long = to_long(known, keep=("b",))
    means = long.groupBy("sample_idx").agg(F.avg("v").alias("centre"))  # one row per sample
    x = F.col("v") - F.col("centre")
    by_byte = long.join(F.broadcast(means), "sample_idx").groupBy("b", "sample_idx").agg(F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.count(F.lit(1)).alias("k"), F.first("centre").alias("centre"))
    counts = known.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    grid = counts.select("b", "c", F.explode(F.sequence(F.lit(0), F.lit(n_hypotheses - 1))).alias("hypothesis")).withColumn("m", model(F.col("b"), F.col("hypothesis")))
    models = grid.groupBy("hypothesis").agg(F.sum("c").cast("double").alias("n"), F.sum(F.col("c") * F.col("m")).alias("sy"), F.sum(F.col("c") * F.col("m") * F.col("m")).alias("syy"))
    samples = by_byte.groupBy("sample_idx").agg(F.sum("s").alias("sx"), F.sum("q").alias("sxx"), F.sum("k").alias("present"), F.first("centre").alias("centre"))
    # at most 256 bytes x hypotheses rows, joined on the byte
    cross = by_byte.join(F.broadcast(grid.select("b", "hypothesis", "m")) if n_hypotheses <= 1024 else grid.select("b", "hypothesis", "m"), "b").groupBy("hypothesis", "sample_idx").agg(F.sum(F.col("s") * F.col("m")).alias("sxy"), F.sum(F.col("k") * F.col("m")).alias("my"))
    joined = cross.join(models, "hypothesis").join(samples, "sample_idx")
    # a missing sample is 0, which lies the centre's negative away from it
    absent, c = F.col("n") - F.col("present"), F.col("centre")
    sums = F.col("sx") - c * absent, F.col("sxx") + c * c * absent, F.col("sy"), F.col("syy"), F.col("sxy") - c * (F.col("sy") - F.col("my"))
    return joined.select("hypothesis", "sample_idx", pearson(F.col("n"), *sums, c).alias("corr"))


# --- user models -----------------------------------------------------------------------------------

MODEL_TEMPLATE = """import numpy as np

def get_leakages(data, keys, hypothesis):
    \"\"\"One value per trace: data is (N, DL) uint8, keys is (N, 0).\"\"\"
    weight = np.array([bin(x).count('1') for x in range(256)])
    return weight[data[:, 0] ^ hypothesis]
"""


def compile_model(source: str) -> Callable:
    """The ``get_leakages`` function of a model's source text."""
    space: dict = {"__name__": "leakage_model"}
    exec(compile(source, "<leakage model>", "exec"), space)  # noqa: S102  the user's own model
    if not callable(space.get("get_leakages")):
        raise ValueError("the model must define a callable get_leakages")
    return space["get_leakages"]


def evaluate_model(model: Callable, data: np.ndarray, hypothesis: int) -> np.ndarray:
    """One float32 per trace. Models take (data, keys, hypothesis) or (data, hypothesis)."""
    args = (data, np.zeros((len(data), 0), np.uint8), hypothesis) if len(inspect.signature(model).parameters) >= 3 else (data, hypothesis)
    out = np.asarray(model(*args), np.float32).reshape(-1)
    if len(out) != len(data):
        raise ValueError(f"the model returned {len(out)} values for {len(data)} traces")
    return out


def check_model(source: str, traces: DataFrame) -> Callable:
    """Dry run on up to five traces with hypothesis 0."""
    model = compile_model(source)
    rows = [bytes(r[0]) for r in traces.orderBy("trace_idx").select("data").limit(5).collect()]
    if rows:
        width = max(map(len, rows))
        evaluate_model(model, np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width), 0)
    return model


#: Hypotheses whose model values a task holds at once, which are a tile's rows; traces of a leakage tile.
HYPOTHESES_EACH, TRACES_EACH = SIDE, 1024
#: Bytes of sums (hypotheses x samples doubles) in a task, and of all traces' data that are broadcast.
MAX_SUMS, MAX_DATA = 2 << 30, 512 << 20


def _bytes_matrix(values: list[bytes | None], width: int) -> np.ndarray:
    """Data of traces as rows of bytes, filled with zeros."""
    return np.frombuffer(b"".join(bytes(v or b"").ljust(width, b"\0") for v in values), np.uint8).reshape(len(values), width)


def cpa_user_model(traces: DataFrame, model: Callable, n_hypotheses: int = 256, n_samples: int = 0, row_local: bool = True, start: int = 0, shifts: DataFrame | None = None, pipeline: tuple = ()) -> DataFrame:
    """CPA with a Python model over the whole ``data``: hypothesis, sample_idx, corr. ``data`` is padded with zeros to the
    longest, samples to the longest trace (or cut to ``n_samples``), whichever batch they come in.

    A row-local model is evaluated where the traces are. Any other (one that subtracts a mean, say) sees the
    data of all traces at once, in trace_idx order: these are broadcast, if they are at most ``MAX_DATA`` bytes, each
    task evaluates whole columns for its hypotheses, and their values meet the samples as tiles of traces by
    hypotheses. Sums that a task could not hold are an error before any trace is read."""
    if not 1 <= n_hypotheses <= MAX_HYPOTHESES:
        raise ValueError(f"hypotheses must be 1 to {MAX_HYPOTHESES}")
    known = prepared(traces, start, n_samples, shifts, pipeline)
    longest = known.agg(F.coalesce(F.max(F.size("samples")), F.lit(0)), F.coalesce(F.max(F.octet_length("data")), F.lit(0)), F.count(F.lit(1))).first()
    ns, width, n = longest
    if 8 * n_hypotheses * ns > MAX_SUMS:
        raise ValueError(f"sums of {n_hypotheses} hypotheses x {ns} samples exceed {MAX_SUMS >> 20} MB: take fewer of either at a time")
    if row_local:
        tiles = _evaluated_in_place(known, model, n_hypotheses, ns, width)
    elif width * n > MAX_DATA:
        raise ValueError(f"the data of all traces, {width * n >> 20} MB, exceed {MAX_DATA >> 20} MB")
    else:
        tiles = _evaluated_whole(known, model, n_hypotheses, ns, width)
    return correlation_cells(added(tiles), False).select(F.col("i").alias("hypothesis"), F.col("j").alias("sample_idx"), "corr")


def _evaluated_in_place(known: DataFrame, model: Callable, n_hypotheses: int, ns: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [Moments(min(HYPOTHESES_EACH, n_hypotheses - h), ns) for h in range(0, n_hypotheses, HYPOTHESES_EACH)]
        for batch in batches:
            if batch.num_rows:
                data, x = _bytes_matrix(batch.column("data").to_pylist(), width), dense(batch.column("samples"), ns)
                for h, own in zip(range(0, n_hypotheses, HYPOTHESES_EACH), sums, strict=True):
                    own.add(np.stack([evaluate_model(model, data, k) for k in range(h, h + len(own.mx))], axis=1).astype(np.float64), x)
        for h, own in zip(range(0, n_hypotheses, HYPOTHESES_EACH), sums, strict=True):
            if own.n:
                yield from map(tile_batch, ([row] for row in own.tiles(h // SIDE, 0, False, SIDE)))

    return known.select("samples", "data").mapInArrow(run, TILE)


def _evaluated_whole(known: DataFrame, model: Callable, n_hypotheses: int, ns: int, width: int) -> DataFrame:
    spark = known.sparkSession
    table = known.select("trace_idx", "data").toArrow()  # bounded by MAX_DATA
    order = np.argsort(ids := table.column("trace_idx").to_numpy(), kind="stable")
    if len(np.unique(ids)) < len(ids):
        raise ValueError("trace indices repeat")
    sent = spark.sparkContext.broadcast((ids[order], _bytes_matrix(table.column("data").to_pylist(), width)[order]))
    fields = "block int, kind int, place int, floats array<float>"

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block of traces and hypothesis."""
        data = sent.value[1]
        for batch in batches:
            for h in batch.column("id").to_pylist():
                y = evaluate_model(model, data, h)
                at = np.append(np.arange(0, len(y), TRACES_EACH), len(y)).astype(np.int32)
                blocks = len(at) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.zeros(blocks, np.int32)), pa.array(np.full(blocks, h, np.int32)), pa.ListArray.from_arrays(pa.array(at), pa.array(y))], ["block", "kind", "place", "floats"])

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = sent.value[0]
        for batch in batches:
            rank = np.searchsorted(ids, batch.column("trace_idx").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array((rank // TRACES_EACH).astype(np.int32)), pa.array(np.ones(len(rank), np.int32)), pa.array((rank % TRACES_EACH).astype(np.int32)), batch.column("samples")], ["block", "kind", "place", "floats"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of traces, one after another: the values of all hypotheses, then the samples."""
        sums = [Moments(min(HYPOTHESES_EACH, n_hypotheses - h), ns) for h in range(0, n_hypotheses, HYPOTHESES_EACH)]
        key, y, places, x = None, [], [], []

        def close() -> None:
            if x:
                leak = np.stack(y, axis=1)[np.concatenate(places)].astype(np.float64)
                for h, own in zip(range(0, n_hypotheses, HYPOTHESES_EACH), sums, strict=True):
                    own.add(leak[:, h : h + len(own.mx)], np.concatenate(x))

        for batch in batches:
            at = np.array([batch.column("block").to_numpy(), batch.column("kind").to_numpy()]).T
            for i, n in zip(*runs(at), strict=True):
                if at[i, 0] != key:
                    close()
                    key, y, places, x = at[i, 0], [], [], []
                own = batch.slice(i, n)
                if at[i, 1] == 0:
                    y += [np.asarray(v, np.float32) for v in own.column("floats").to_pylist()]
                else:
                    places.append(own.column("place").to_numpy())
                    x.append(dense(own.column("floats"), ns))
        close()
        for h, own in zip(range(0, n_hypotheses, HYPOTHESES_EACH), sums, strict=True):
            if own.n:
                yield from map(tile_batch, ([row] for row in own.tiles(h // SIDE, 0, False, SIDE)))

    leaks = spark.range(n_hypotheses).repartition(min(n_hypotheses, 200)).mapInArrow(values, fields)
    rows = known.select("trace_idx", F.col("samples").cast("array<float>").alias("samples")).mapInArrow(samples, fields)
    return leaks.unionByName(rows).repartition("block").sortWithinPartitions("block", "kind", "place").mapInArrow(meet, TILE)


def rank_hypotheses(result: DataFrame) -> DataFrame:
    """Per hypothesis its peak |corr| and the first sample that reaches it; sample 0 if all are 0."""
    best = result.groupBy("hypothesis").agg(F.min(F.struct((-F.abs("corr")).alias("x"), F.col("sample_idx"), F.col("corr"))).alias("m"))
    return best.select("hypothesis", (-F.col("m.x")).alias("peak"), F.col("m.sample_idx").alias("sample_idx"), F.col("m.corr").alias("corr"))


def top_hypotheses(result: DataFrame, n: int = 16, n_hypotheses: int = 256) -> DataFrame:
    name = F.format_string("0X%02X", "hypothesis") if n_hypotheses <= 256 else F.col("hypothesis").cast("string")
    return rank_hypotheses(result).orderBy(F.desc("peak"), "hypothesis").limit(n).withColumn("name", name)
