"""Out-of-order events of a running stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from panemill.functions.metrics import out_of_order
from panemill.streaming.state import BatchState, StreamQuery


def out_of_order_stream(events: DataFrame, arrival: str = "event_id") -> StreamQuery:
    """(batch, stream_id, events, late, ratio): after each micro-batch, how many of a stream's events came after a later one.

    Counts are of all batches so far. The state is a row for each stream: its latest time, events and late events. Within a
    batch events are in the order of ``arrival``; nothing of a batch is put in order by one task as a whole. The batch's
    number of events and latest time are observed as ``arrived``, which ``ProgressLog`` keeps.
    """
    rows = events.observe("arrived", F.count(F.lit(1)).alias("events"), F.max("event_ts").alias("latest")).select("stream_id", "event_ts", F.col(arrival).alias("arrival"))
    known = StructType([rows.schema["stream_id"], *[StructField(c, LongType()) for c in ("top", "events", "late")]])

    def finish(closed: DataFrame, state: BatchState) -> DataFrame:
        before = state.read("streams", known)
        counts = out_of_order(closed, "arrival", before.select("stream_id", "top")).drop("ratio")
        tops = closed.groupBy("stream_id").agg(F.max("event_ts").alias("top"))
        both = before.unionByName(counts, allowMissingColumns=True).unionByName(tops, allowMissingColumns=True)
        now = state.write("streams", both.groupBy("stream_id").agg(*[f(c).alias(c) for f, c in ((F.max, "top"), (F.sum, "events"), (F.sum, "late"))]))
        return now.select(F.lit(state.batch).cast("bigint").alias("batch"), "stream_id", "events", "late", (F.col("late") / F.col("events")).alias("ratio"))

    results = StructType([StructField("batch", LongType()), known["stream_id"], known["events"], known["late"], StructField("ratio", DoubleType())])
    return StreamQuery(rows, finish, results)
