"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) of comparable ids to (node, label): the smallest id of each node's component,
    for every node that has a link and is not itself the smallest.

    Large-star joins every larger neighbour of a node to the node's smallest neighbour, small-star
    does so with the smaller ones; at the fixed point every node points at its component's
    smallest id. Nodes of many links are reduced by partial aggregation and rejoined, never collected.
    """
    edges = scratch.write(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        edges = scratch.write(small, f"{name}-{step}")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        scratch.drop(f"{name}-{step - 1}")
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
