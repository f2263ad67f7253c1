"""Rows of a stream that wait in tables until the watermark has passed them, whatever batch they came in.

Spark's state holds each row it knows in an executor's memory, twice while a batch runs. Tables hold it on disk, and what
closes is put together by bounded joins and groupings. Late and closed rows are told just as Spark tells them: a batch closes
what the watermark of all batches before it has passed, and what the batch before has closed is late. The last batch is
one without rows, which Spark runs when a watermark has moved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.sources.events import union_streams
from panemill.streaming.state import BatchState

TOPS = "source int, top bigint, before bigint"
#: The batch's rows as they came: see ``panemill.streaming.sinks``.
ROWS = "rows"


def coming(sources: Sequence[DataFrame], marked: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(source, at, ends, columns): the rows of all sources with a time, closing marks among them.

    ``marked`` is the same stream with its watermarks. A row of state for each of its days is what moves with the watermark;
    these rows have no source.
    """
    found = []
    for i, rows in enumerate(sources):
        ends = F.coalesce(F.col("ends"), F.lit(False)) if "ends" in rows.columns else F.lit(False)
        found.append(rows.where("ts IS NOT NULL").select(F.lit(i).alias("source"), F.unix_millis("ts").alias("at"), ends.alias("ends"), *columns))
    days = marked.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("at"))
    return union_streams(*found, days.select("at"))


def of_events(rows: DataFrame) -> DataFrame:
    """The events among the rows of ``coming``, and nothing but their columns and ``at``."""
    return rows.where("source IS NOT NULL AND NOT ends").drop("source", "ends")


def watermarks(rows: DataFrame, state: BatchState, sources: int, lateness_ms: int) -> tuple[int, int]:
    """The watermarks up to which rows of this batch are late, and up to which the batch closes windows.

    The latest time of each source is the only thing that the driver keeps; the slowest source counts.
    """
    known = {r.source: (r.top, r.before) for r in state.read("tops", state.spark.createDataFrame([], TOPS).schema).collect()}
    came = {r.source: r.top for r in rows.where("source IS NOT NULL").groupBy("source").agg(F.max("at").alias("top")).collect()}
    now = [(s, max(x for x in (came.get(s), known.get(s, (None, None))[0]) if x is not None), known.get(s, (None, None))[0]) for s in {*came, *known}]
    state.write("tops", state.spark.createDataFrame(now, TOPS).coalesce(1))

    def passed(place: int) -> int:
        tops = [t[place] for t in known.values() if t[place] is not None]
        return max(0, min(tops) - lateness_ms) if len(tops) == sources else 0

    return passed(1), passed(0)
