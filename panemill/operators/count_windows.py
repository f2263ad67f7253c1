"""Windows over counts of events, in the order of event time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panemill.functions.aggregates import Aggregate
from panemill.plans.panes import ORDERED, finished, holistic, kept_by, lifted
from panemill.plans.spec import WindowSpec
from panemill.sources.events import NO_KEY

#: Events are put in order within spans of time that hold so many on average; how many lie before a span is summed up.
SPAN_EVENTS = 50_000
ORDER = ("event_ts", "stream_id", "event_id")


def span_of(events: DataFrame) -> int:
    """The length in ms of spans that hold SPAN_EVENTS events on average."""
    n, low, high = events.agg(F.count("event_ts"), F.min("event_ts"), F.max("event_ts")).first()
    return max(1, (high - low + 1) * SPAN_EVENTS // n) if n else 1


def with_place(events: DataFrame, by: Sequence[str] = (), span_ms: int | None = None) -> DataFrame:
    """Add ``place``, an event's number from 0 in the order of event_ts, stream_id and event_id, within ``by``.

    No task sorts more than a span: the events before each span come from counts of spans (and values of ``by``).
    """
    spanned = events.withColumn("span", F.floor(F.col("event_ts") / (span_ms or span_of(events))))
    counts = spanned.groupBy(*by, "span").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*by).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*[F.col(c).alias(f"b_{c}") for c in (*by, "span")], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*by, "span").orderBy(*ORDER)
    same = F.expr(" AND ".join(f"{c} <=> b_{c}" for c in (*by, "span")))
    placed = spanned.withColumn("within", F.row_number().over(within) - 1).join(bases, same)
    return placed.withColumn("place", F.col("base") + F.col("within")).select(*events.columns, "place")


def in_count_windows(placed: DataFrame, window: WindowSpec) -> DataFrame:
    """Each row of ``placed`` (place, ...) once for each window that it lies in, with window_start."""
    last = F.expr(f"place - place % {window.slide}")
    if window.size == window.slide:
        return placed.withColumn("window_start", last)
    first = F.greatest(last - F.lit((window.size - 1) // window.slide * window.slide), F.lit(0))
    copies = placed.withColumn("window_start", F.explode(F.sequence(first, last, F.lit(window.slide).cast("bigint"))))
    return copies.where(F.col("place") < F.col("window_start") + window.size)


def window_parts(rows: DataFrame, functions: Sequence[Aggregate]) -> DataFrame:
    """(window_start, key, value for holistic functions, events, parts) of rows in count windows."""
    return rows.groupBy("window_start", *kept_by(functions)).agg(F.count(F.lit(1)).alias("events"), *lifted(functions))


def full(parts: DataFrame, window: WindowSpec) -> DataFrame:
    """Add ``full``: whether all events of a window are there."""
    return parts.withColumn("full", F.sum("events").over(Window.partitionBy("window_start", "key")) == window.size)


def numbered_by_key(events: DataFrame, seen: DataFrame) -> DataFrame:
    """(key, value, place, low, high) of events: the place within the key, and those of its first event here and after
    its last one, by ``seen`` (key, before, here), how many of its events were before and are here.

    One shuffle by key is all; one task puts a key in order.
    """
    both = events.unionByName(seen.where("here > 0"), allowMissingColumns=True)
    # the key's row of ``seen`` has no time, so that it stands before all others
    by_key = Window.partitionBy("key").orderBy(*ORDER)
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = both.withColumns({"before": F.max("before").over(upto), "here": F.max("here").over(upto), "no": F.row_number().over(by_key)})
    return told.where("event_ts IS NOT NULL").select("key", "value", (F.col("before") + F.col("no") - 2).alias("place"), F.col("before").alias("low"), (F.col("before") + F.col("here")).alias("high"))


def numbered_by_span(events: DataFrame, seen: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same of events that no task sees all of: within ``by``, ordered by spans of time."""
    both = with_place(events, by).alias("x").join(F.broadcast(seen).alias("y") if not by else seen.alias("y"), F.expr("x.key <=> y.key"))
    return both.select("x.key", "x.value", (F.col("x.place") + F.col("y.before")).alias("place"), F.col("y.before").alias("low"), (F.col("y.before") + F.col("y.here")).alias("high"))


def _whole(window: WindowSpec) -> Column:
    """Whether a window lies within what is numbered here."""
    return (F.col("window_start") >= F.col("low")) & (F.col("window_start") + window.size <= F.col("high"))


def whole_windows(numbered: DataFrame, window: WindowSpec, functions: Sequence[Aggregate], *, by_key: bool) -> DataFrame:
    """The results of the windows that lie within what is numbered here.

    Rows dealt ``by_key`` stay where they are. Else events, and not their copies for each window, are dealt to blocks of
    windows: those that start in a block are finished there. Windows too large for that are put together by their parts.
    """
    few, beside = window.size <= ORDERED, []
    if few and not by_key:
        block = -(-max(window.size, SPAN_EVENTS) // window.slide) * window.slide
        first = F.greatest(F.col("place") - F.lit(window.size - 1), F.lit(0))
        blocks = F.sequence(F.floor(first / block), F.floor(F.col("place") / block))
        numbered = numbered.withColumn("block", F.explode(blocks)).repartition("key", "block")
        rows, beside = in_count_windows(numbered, window).where(F.floor(F.col("window_start") / block) == F.col("block")), ["block"]
    else:
        rows = in_count_windows(numbered, window)
    parts = rows.where(_whole(window)).groupBy("window_start", *kept_by(functions), *beside).agg(*lifted(functions))
    return finished(with_ends(parts, window), functions, few=few, beside=beside)


def border_windows(numbered: DataFrame, window: WindowSpec) -> DataFrame:
    """The rows of all other windows: these begin before what is numbered here or end after it."""
    near = numbered.where((F.col("place") < F.col("low") + window.size) | (F.col("place") >= F.col("high") - window.size))
    return in_count_windows(near, window).where(~_whole(window))


def with_ends(parts: DataFrame, window: WindowSpec) -> DataFrame:
    return parts.withColumns({"window_id": F.lit(window.window_id).cast("bigint"), "window_end": F.col("window_start") + window.size})


def without_key(events: DataFrame) -> DataFrame:
    return events.withColumn("key", F.lit(NO_KEY).cast("bigint"))


def count_windows(events: DataFrame, window: WindowSpec, functions: Sequence[Aggregate], scope: str = "global") -> DataFrame:
    """(window_id, window_start, window_end, key, value_0, ...) of windows of ``size`` events, ``slide`` events apart.

    Start and end are places in the order of events, those with null values among them. Windows that are not full at the
    end give no result. In the global scope keys are ignored and the result has none; in the key scope each key counts
    its own events.
    """
    placed = with_place(events, ["key"]) if scope == "key" else without_key(with_place(events))
    parts = window_parts(in_count_windows(placed, window), functions)
    done = full(parts, window).where("full") if holistic(functions) else parts.where(F.col("events") == window.size)
    return finished(with_ends(done, window), functions, few=window.size <= ORDERED)
