"""Helpers shared by the training-data operators: table access, scratch space
in the folder that all executors share, and size estimates."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The named table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset and all tasks run in this
    process (tests, one machine) a temporary folder is made and set for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def give_back_memory() -> None:
    """Returns freed memory of this process to the system, where the C library can: the allocators keep
    it otherwise for as long as the process lives."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim is not None:
        trim(0)


_HELD: dict[str, Callable[[], object]] = {}


def hold(name: str, forget: Callable[[], object] | None = None) -> None:
    """Tells whose caches this process keeps from here on; ``forget`` drops them. Those of other operators,
    whose tasks ran here before, are dropped now."""
    for other in [x for x in _HELD if x != name]:
        _HELD.pop(other)()
    if forget is not None:
        _HELD[name] = forget


class Scratch:
    """Tables written below the shared folder, so that lineage is cut without depending on any
    executor.  ``drop`` removes one; leaving the ``with`` block removes all that ``keep`` did
    not name."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """As ``write``, but the table outlives the block: it is what the operator returns."""
        out = self.write(df, name)
        self.names.discard(name)
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")
            self.names.discard(name)
        self.spark._jvm.System.gc()  # shuffle files of finished jobs go with their references

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*list(self.names))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a DataFrame, to three digits (for a Parquet scan: bytes of
    its files); 0 where the optimizer knows none and assumes exabytes."""
    found = re.search(r"sizeInBytes=([\d.E+]+) (\w*)B", df._jdf.queryExecution().optimizedPlan().stats().simpleString())
    units = {"": 0, "Ki": 1, "Mi": 2, "Gi": 3, "Ti": 4, "Pi": 5}
    return int(float(found[1]) * 1024 ** units[found[2]]) if found and found[2] in units else 0


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """A partition count that grows with the input, so that no task's share does."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-plan_bytes(df) // bytes_each))


#: Copies of each row of a smaller side that a spread join makes.
SALTS = 16


def spread_join(rows: DataFrame, small: DataFrame, on: list[str], by: list[str], n: int, limit: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with a side of ``n`` rows on equal columns: broadcast up to ``limit`` rows; beyond
    that shuffled, the rows of one key being dealt over ``SALTS`` tasks by the columns ``by``."""
    if n <= limit:
        return rows.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(salted, [*on, "__salt"], how).drop("__salt")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_hash_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def eager(value: Column) -> Column:
    """The same value, computed once per row below an explode. Generated code defers plain
    expressions to where they are used, which after an explode is once per exploded row; one
    that counts as non-deterministic is computed in place."""
    return F.when(F.rand(0) >= 0, value)
