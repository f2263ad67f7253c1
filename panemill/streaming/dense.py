"""Windows without events in a stream: a timer for each known key gives them when the watermark passes their end."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from panemill.plans.panes import GROUP
from panemill.plans.spec import WindowSpec

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Filling(StatefulProcessor):
    """Of each key the state is the start of the next window, and a timer at that window's end."""

    def __init__(self, size: int, slide: int) -> None:
        self.size, self.slide = size, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.next = handle.getValueState("next", "start long")

    def _rows(self, key: tuple, starts: list[int], values: list[str | None]) -> pd.DataFrame:
        return pd.DataFrame({"key": pd.Series([key[0]] * len(starts), dtype=object), "window_start": pd.Series(starts, dtype="int64"), "results": pd.Series(values, dtype=object)})

    def _go_on(self, start: int) -> None:
        if self.next.exists():
            before = self.next.get()[0]
            if before == start:
                return
            self.handle.deleteTimer(before + self.size)
        self.next.update((start,))
        self.handle.registerTimer(start + self.size)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own: dict[int, str] = {}
        for some in rows:
            own.update(zip(some["window_start"].tolist(), some["results"].tolist(), strict=True))
        following = self.next.get()[0] if self.next.exists() else min(own)
        starts = sorted({*own, *range(following, max(own), self.slide)})
        yield self._rows(key, starts, [own.get(s) for s in starts])
        self._go_on(max(starts[-1] + self.slide, following))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        following, passed = self.next.get()[0], timerValues.getCurrentWatermarkInMs()
        starts = list(range(following, passed - self.size + 1, self.slide))
        if starts:
            yield self._rows(key, starts, [None] * len(starts))
            self._go_on(starts[-1] + self.slide)

    def close(self) -> None:
        pass


def with_empty_windows_of_stream(results: DataFrame, window: WindowSpec) -> DataFrame:
    """Fill a stream's results (window_start, key, value_0, ...) of one fixed window: a row of nulls for each window of
    a key without events, from the key's first window with events on.

    A key is known from its first result on. Its timer gives the empty windows that the watermark passes, also in batches
    without events of the key; a key that never comes back is given until the stream ends. Only results go to Python, a row
    for each window and key, and values go there and back as text, so that no number loses digits. Sets the session's state
    store to RocksDB, which timers need.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    values = [c for c in results.columns if c not in GROUP]
    packed = results.select("key", "window_start", F.to_json(F.struct(*values)).alias("results"))
    key = results.schema["key"].dataType.simpleString()
    filled = packed.groupBy("key").transformWithStateInPandas(_Filling(window.size, window.slide), f"key {key}, window_start long, results string", "Append", "EventTime")
    unpacked = filled.withColumn("r", F.from_json("results", ", ".join(f"{c} long" for c in values)))
    return unpacked.select(F.lit(window.window_id).cast("bigint").alias("window_id"), "window_start", (F.col("window_start") + window.size).alias("window_end"), "key", *[F.col(f"r.{c}").alias(c) for c in values])
