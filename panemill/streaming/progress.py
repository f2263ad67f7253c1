"""What a running stream reports: rates, watermark, and whether it keeps up with its sources."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

#: A stream falls behind if so many batches in a row took longer than it took their rows to come in.
SLOW_BATCHES = 10


@dataclass
class Batch:
    query: str
    batch_id: int
    rows: int
    input_rate: float
    processed_rate: float
    duration_ms: int
    watermark: str | None
    #: What the query's ``observe`` metrics were, by their names.
    observed: dict = field(default_factory=dict)


def falls_behind(batches: list[Batch], slow: int = SLOW_BATCHES) -> bool:
    """Whether the last ``slow`` batches with rows all processed fewer rows a second than came in."""
    last = [b for b in batches if b.rows][-slow:]
    return len(last) == slow and all(b.processed_rate < b.input_rate for b in last)


@dataclass
class ProgressLog(StreamingQueryListener):
    """Keeps the latest batches of all queries of a session: ``spark.streams.addListener(ProgressLog())``."""

    keep: int = 1000
    batches: list[Batch] = field(default_factory=list)

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.batches.append(Batch(str(p.id), p.batchId, p.numInputRows, p.inputRowsPerSecond, p.processedRowsPerSecond, p.batchDuration, p.eventTime.get("watermark"), {name: row.asDict() for name, row in p.observedMetrics.items()}))
        del self.batches[: -self.keep]

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def rows_per_second(self, query: str) -> float:
        """Rows processed a second over all kept batches of a query; 0 before the first."""
        own = [b for b in self.batches if b.query == query]
        seconds = sum(b.duration_ms for b in own) / 1000
        return sum(b.rows for b in own) / seconds if seconds else 0.0
