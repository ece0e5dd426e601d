"""Online statistics: the batch sums over a stream of traces, the closed formula at each trigger.

The sums are additive, so a streaming aggregation in complete mode holds one row per sample (and
class or byte) as state, whatever the number of traces. A group counts the traces of the sample that most
of them have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tracewright.model import to_long
from tracewright.operators.stats import snr_of, snr_sums, ttest_sums, welch


def start(sums: DataFrame, finish, sink, checkpoint: str | None = None) -> StreamingQuery:
    """Runs ``sink(result, batch_id)`` with the finished statistic after every micro-batch."""
    writer = sums.writeStream.outputMode("complete").foreachBatch(lambda df, i: sink(finish(df), i))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def online_ttest(stream: DataFrame, sink, checkpoint: str | None = None) -> StreamingQuery:
    return start(ttest_sums(to_long(stream, keep=("grp",))), welch, sink, checkpoint)


def online_snr(stream: DataFrame, n_classes: int, sink, checkpoint: str | None = None) -> StreamingQuery:
    return start(snr_sums(to_long(stream, keep=("cls",)), n_classes), snr_of, sink, checkpoint)
