"""Measures of a stream: out-of-order events, rates and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Events of a range of arrival, on average: a range is put in order by one task.
RANGE_EVENTS = 50_000


def out_of_order(events: DataFrame, arrival: str = "event_id", before: DataFrame | None = None) -> DataFrame:
    """(stream_id, events, late, ratio): how many of a stream's events come after a later one, in the order of arrival.

    ``arrival`` is a number. A stream is cut into ranges of arrival, as many as its events need: the latest time of all
    ranges before comes from one row for each range, and only a range is put in order by one task. Events that arrive at
    once are in the order of their time. ``before`` (stream_id, top): the latest times of what has come earlier.
    """
    bounds = events.agg(F.min(arrival).alias("low"), F.max(arrival).alias("high"), (F.floor(F.count(F.lit(1)) / RANGE_EVENTS) + 1).alias("ranges"))
    share = (F.col(arrival).cast("double") - F.col("low")) / (F.col("high").cast("double") - F.col("low") + 1)
    ranged = events.join(F.broadcast(bounds)).select("stream_id", "event_ts", F.col(arrival).alias("arrival"), F.floor(share * F.col("ranges")).alias("range"))
    earlier = Window.partitionBy("stream_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    tops = ranged.groupBy("stream_id", "range").agg(F.max("event_ts").alias("top"))
    if before is not None:
        tops = tops.unionByName(before.select("stream_id", F.lit(-1).cast("bigint").alias("range"), "top"))
    tops = tops.select("stream_id", "range", F.max("top").over(earlier).alias("top"))
    inside = Window.partitionBy("stream_id", "range").orderBy("arrival", "event_ts").rowsBetween(Window.unboundedPreceding, -1)
    latest = ranged.withColumn("own", F.max("event_ts").over(inside)).alias("x").join(tops.alias("y"), F.expr("x.stream_id <=> y.stream_id AND x.range <=> y.range"))
    late = F.coalesce(F.col("event_ts") < F.greatest("own", "top"), F.lit(False))
    rows = latest.select("x.stream_id", late.cast("bigint").alias("late"))
    return rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("events"), F.sum("late").alias("late")).withColumn("ratio", F.col("late") / F.col("events"))


def events_per_second(events: DataFrame) -> DataFrame:
    """(stream_id, second, events): how many events fall in each second of event time."""
    return events.groupBy("stream_id", F.floor(F.col("event_ts") / 1000).alias("second")).agg(F.count(F.lit(1)).alias("events"))


def received_per_second(results: DataFrame, received: str) -> DataFrame:
    """(second, results, latency_ms): of results that came in at ``received`` (ms) how many there were in each second, and
    their mean latency without its fraction. A result's value is the time that it is about; empty ones don't count."""
    known = results.where("value IS NOT NULL").withColumn("latency", F.col(received) - F.col("value"))
    sums = known.groupBy(F.floor(F.col(received) / 1000).alias("second")).agg(F.count(F.lit(1)).alias("results"), F.sum("latency").alias("total"))
    return sums.select("second", "results", F.expr("total div results").alias("latency_ms"))
