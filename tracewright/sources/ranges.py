"""What readers of trace files share: filters on ``trace_idx`` that become ranges, and partitions of units.

A unit is a chunk of a trace, or a whole trace.  Readers seek to the units of a partition and read only the
columns that their schema names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

#: Bytes of a partition and of one Arrow batch.
PARTITION_BYTES, BATCH_BYTES = 32 << 20, 4 << 20


class Units(InputPartition):
    """Units first to last - 1, counted over the traces that are read."""

    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


@dataclass
class TraceSelection:
    """The traces lo to hi - 1, of those only the listed ones where there is a list."""

    lo: int
    hi: int
    listed: list[int] | None = None

    def push(self, filters: Iterable[Filter]) -> Iterator[Filter]:
        """Takes the filters on trace_idx that it can; yields the others."""
        for f in filters:
            if getattr(f, "attribute", None) != ("trace_idx",):
                yield f
            elif isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self._only([f.value])
            elif isinstance(f, In):
                self._only([v for v in f.value if v is not None])
            elif isinstance(f, GreaterThan):
                self.lo = max(self.lo, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.lo = max(self.lo, f.value)
            elif isinstance(f, LessThan):
                self.hi = min(self.hi, f.value)
            elif isinstance(f, LessThanOrEqual):
                self.hi = min(self.hi, f.value + 1)
            elif not isinstance(f, IsNotNull):  # no trace index is null
                yield f

    def _only(self, values: list[int]) -> None:
        self.listed = sorted(set(values) if self.listed is None else set(values) & set(self.listed))

    @property
    def traces(self) -> range | list[int]:
        return range(self.lo, max(self.lo, self.hi)) if self.listed is None else [t for t in self.listed if self.lo <= t < self.hi]


def push_filters_on(spark: SparkSession) -> None:
    """Lets Spark offer filters to Python data sources, which it does not by itself."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def split(units: int, bytes_each: int, rows: int = 0) -> list[InputPartition]:
    """Partitions of ``rows`` units, else of about ``PARTITION_BYTES``; one of none where there are no units."""
    each = rows or max(1, PARTITION_BYTES // max(1, bytes_each))
    return [Units(a, min(units, a + each)) for a in range(0, units, each)] or [Units(0, 0)]
