"""Tables behind plots: per-pixel extremes, sampled and blurred matrices, nearest traces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_extremes(long: DataFrame, start: int, length: int, width: int) -> DataFrame:
    """Minimum and maximum of each pixel column of a view of every trace."""
    seen = long.where((F.col("sample_idx") >= start) & (F.col("sample_idx") < start + length))
    return seen.groupBy("trace_idx", F.floor((F.col("sample_idx") - start) * width / F.lit(length)).cast("int").alias("pixel")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def sampled_matrix(matrix: DataFrame, rows: tuple[int, int], columns: tuple[int, int], width: int, height: int, value: str = "corr") -> DataFrame:
    """Nearest-neighbour view of a matrix window: x, y, value at each pixel's centre."""
    spark = matrix.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).cast("int").alias("x"), F.floor(F.col("id") / width).cast("int").alias("y"))
    at = lambda p, size, span: F.least(F.lit(span[1] - 1), F.lit(span[0]) + F.floor((F.col(p) + F.lit(0.5)) * (span[1] - span[0]) / F.lit(size))).cast("int")
    wanted = grid.select("x", "y", at("y", height, rows).alias("i"), at("x", width, columns).alias("j"))
    return matrix.join(F.broadcast(wanted), ["i", "j"]).select("x", "y", F.col(value).alias("value"))  # width x height rows


def gaussian_blur(matrix: DataFrame, sigma: float, n_rows: int, n_columns: int, value: str = "corr") -> DataFrame:
    """Separable blur of radius max(1, ceil(3 sigma)), edges repeated. Each cell is sent to the cells
    it contributes to, with its kernel weight; the two passes are two aggregations."""
    radius = max(1, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x / sum(raw)).alias("w")) for k, x in zip(range(-radius, radius + 1), raw, strict=True)])

    def once(m: DataFrame, axis: str, other: str, n: int) -> DataFrame:
        # target t reads source clamp(t + k): inner sources serve t = source - k, edges also what is clamped to them
        spread = m.select(other, axis, "value", F.explode(kernel).alias("e")).select(other, axis, "value", "e.k", "e.w")
        last = F.col(axis) - F.col("k")
        first = F.when(F.col(axis) == 0, F.lit(0)).otherwise(last)
        last = F.when(F.col(axis) == n - 1, F.lit(n - 1)).otherwise(last)
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        targets = spread.withColumn("a", first).withColumn("b", last).where("a <= b").select(other, F.explode(F.sequence("a", "b")).alias(axis), (F.col("value") * F.col("w")).alias("p"))
        return targets.groupBy(other, axis).agg(F.sum("p").alias("value"))

    start = matrix.select("i", "j", F.col(value).alias("value"))
    return once(once(start, "j", "i", n_columns), "i", "j", n_rows).select("i", "j", "value")


def nearest_trace(long: DataFrame, sample: int, value: float) -> DataFrame:
    """The trace closest in value at a sample; the lowest index of equals."""
    return long.where((F.col("sample_idx") == sample) & ~F.isnan("v")).select("trace_idx", "v", F.abs(F.col("v") - F.lit(value)).alias("distance")).orderBy("distance", "trace_idx").limit(1)


def preview(traces: DataFrame, n: int) -> DataFrame:
    return traces.orderBy("trace_idx").limit(n)
