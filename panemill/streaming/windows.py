"""The same windows over unbounded streams: watermarks, bounded lateness, each window once when it is final."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panemill.functions.aggregates import Aggregate
from panemill.functions.aggregates import Aggregate
from panemill.operators.count_windows import border_windows, full, numbered_by_key, numbered_by_span, whole_windows, window_parts, with_ends, without_key
from panemill.operators.sessions import session_counts, spark_sessions, with_sessions
from panemill.plans.panes import GROUP, ORDERED, finished, fits, holistic, in_windows, kept_by, lifted, merged, panes_pay, windows_over
from panemill.plans.spec import LATENESS_MS, QuerySpec, WindowSpec
from panemill.sources.events import union_streams
from panemill.streaming.state import BatchState, StreamQuery
from panemill.streaming.waiting import ROWS, coming, of_events, watermarks

#: Marks a column as event time for the operators after it, as withWatermark does: an end of a window that is worked out
#: from a pane has to say so itself. The watermark is that of the panes.
EVENT_TIME = {"spark.watermarkDelayMs": 0}


def watermarked(events: DataFrame, lateness_ms: int = LATENESS_MS) -> DataFrame:
    """Events with a watermark. Closing marks lift it and are left out."""
    found = events.withWatermark("ts", f"{lateness_ms} milliseconds")
    if "ends" not in found.columns:
        return found
    # a condition without the time would be moved to before the watermark, which then never saw the marks
    return found.where("ends IS NULL OR NOT ends OR ts IS NULL").drop("ends")


def _marked(events: DataFrame | Sequence[DataFrame], lateness_ms: int) -> DataFrame:
    """The union of sources, each with its own watermark: the slowest one's closes the windows."""
    return union_streams(*[watermarked(s, lateness_ms) for s in ([events] if isinstance(events, DataFrame) else events)])


def closing_ms(last_ms: int, query: QuerySpec, lateness_ms: int = LATENESS_MS) -> int:
    """The time of a closing mark that lifts the watermark past all windows that an event at ``last_ms`` can be in."""
    return last_ms + max([w.size for w in query.windows if w.measure == "TIME"], default=0) + lateness_ms + 2


def _results(rows: DataFrame, functions: Sequence[Aggregate]) -> StructType:
    values = [StructField(f"value_{i}", LongType()) for i in range(len(functions))]
    return StructType([StructField(c, LongType()) for c in GROUP[:3]] + [rows.schema["key"], *values])


def _shares(windows: Sequence[WindowSpec]) -> bool:
    return len(windows) > 1 or panes_pay(windows)


def fixed_window_rows(events: DataFrame, windows: Sequence[WindowSpec], functions: Sequence[Aggregate], pane_ms: int, *, share: bool | None = None) -> DataFrame:
    """The parts of tumbling and sliding windows of a stream with a watermark, each once when it has passed their end.

    Several windows, and one in which an event lies often, share panes: one state of panes that the watermark closes, and
    one state of windows, to which only closed panes are added. An event is then late when its pane has closed; without
    shared panes, each window has a state of its own and an event is late when the window has closed.
    """
    by = kept_by(functions)
    names = [*GROUP[:3], *by]
    if not (_shares(windows) if share is None else share):
        found = []
        for w in windows:
            parts = events.groupBy(F.window("ts", f"{w.size} milliseconds", f"{w.slide} milliseconds").alias("span"), *by).agg(*lifted(functions))
            rows = parts.select(F.lit(w.window_id).cast("bigint").alias("window_id"), F.unix_millis("span.start").alias("window_start"), F.unix_millis("span.end").alias("window_end"), "*")
            found.append(rows.where("window_start >= 0").drop("span"))
        return reduce(DataFrame.unionByName, found)
    panes = events.groupBy(F.window("ts", f"{pane_ms} milliseconds").alias("pane"), *by).agg(*lifted(functions))
    copies = panes.withColumn("w", F.explode(windows_over(F.unix_millis("pane.start"), windows))).select("w.*", "*")
    closing = copies.withColumn("closes", F.timestamp_millis("window_end").alias("closes", metadata=EVENT_TIME))
    return closing.groupBy(*names, "closes").agg(*merged(functions)).drop("closes")


def query_stream(events: DataFrame | Sequence[DataFrame], query: QuerySpec, lateness_ms: int = LATENESS_MS, *, share: bool | None = None) -> DataFrame | StreamQuery:
    """All time windows of a query over a stream, or over the union of several.

    Fixed windows share panes (see ``fixed_window_rows``); sessions have a state of their own. Holistic functions keep
    counts of different values in the state, never lists: what closes is finished batch by batch, as a bounded query
    does it. With sessions and holistic functions all counts wait in tables (see ``_waiting_query``). Count windows: see
    ``count_window_stream``.
    """
    if query.counts():
        raise ValueError("count windows of a stream are a query of their own")
    functions = query.functions
    if holistic(functions) and query.sessions():
        return _waiting_query([events] if isinstance(events, DataFrame) else events, query, lateness_ms, share=_shares(query.fixed()) if share is None else share)
    marked = _marked(events, lateness_ms)
    if not query.keyed:
        marked = without_key(marked)
    fixed = [fixed_window_rows(marked, query.fixed(), functions, query.pane_ms(), share=share)] if query.fixed() else []
    if not holistic(functions):
        rows = fixed + [spark_sessions(marked, w, functions) for w in query.sessions()]
        return finished(reduce(DataFrame.unionByName, rows), functions, few=True)

    def finish(closed: DataFrame, state: BatchState) -> DataFrame:
        return finished(closed, functions, few=fits(closed, GROUP))

    return StreamQuery(fixed[0], finish, _results(fixed[0], functions))


def _waiting_query(sources: Sequence[DataFrame], query: QuerySpec, lateness_ms: int, *, share: bool) -> StreamQuery:
    """Sessions, and fixed windows beside them, with holistic functions: counts of values wait in tables.

    A batch's events are counted by window and value, and for sessions by stretch of time as long as the gap and value.
    A window closes with the counts of its own batch; a session that gets an event closes in a later batch, so that it has
    all events that came with that one.
    """
    functions, fixed, pane = query.functions, query.fixed(), query.pane_ms()
    stream = coming(sources, _marked(sources, lateness_ms), ["key", "value"])

    def finish(rows: DataFrame, state: BatchState) -> DataFrame:
        late, closing = watermarks(rows, state, len(sources), lateness_ms)
        came = of_events(rows).where("at >= 0").withColumnRenamed("at", "event_ts")
        came = came if query.keyed else without_key(came)
        found = []
        if fixed:
            # with shared panes an event is late when its pane has closed, else when its window has
            on_time = came.where(F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(pane)) + pane > late) if share else came
            counts = in_windows(on_time, fixed, pane, functions, share=share).where(F.col("window_end") > late)
            found.append(_closed_windows(counts, state, functions, late, closing))
        for i, w in enumerate(query.sessions()):
            counts = session_counts(came.where(F.col("event_ts") + w.size > late), w, functions)
            found.append(_closed_sessions(counts, state, f"session{i}", w, functions, closing))
        return reduce(DataFrame.unionByName, found)

    return StreamQuery(stream, finish, _results(stream, functions), waits=True)


def _closed_windows(counts: DataFrame, state: BatchState, functions: Sequence[Aggregate], late: int, closing: int) -> DataFrame:
    """The results of fixed windows that a batch closes; the counts of all others go on waiting."""
    end = F.col("window_end")
    # of the counts that came with the batch before, that batch has closed those up to what is late now
    before = state.read("windows", counts.schema).where(end > late).unionByName(state.read("open_windows", counts.schema))
    new = state.write("windows", counts)
    state.write("open_windows", before.where(end > closing))
    closed = before.unionByName(new).where(end <= closing)
    few = fits(closed, GROUP)
    # dealt by window and key once, for all steps
    closed = (closed.repartition(*GROUP) if few else closed).groupBy(*GROUP, "value").agg(*merged(functions))
    return finished(closed, functions, few=few)


def _closed_sessions(counts: DataFrame, state: BatchState, name: str, window: WindowSpec, functions: Sequence[Aggregate], closing: int) -> DataFrame:
    """The results of the sessions that a batch closes; the counts of all others go on waiting.

    A session is open if it reaches the first of its key's rows that are new or not yet passed by the watermark.
    """
    before = state.read(name, counts.schema).unionByName(state.read(f"open_{name}", counts.schema))
    new = state.write(name, counts)
    passed = F.col("last") + window.size <= closing
    old, young = before.where(passed), before.where(~passed)
    following = new.unionByName(young).groupBy("key").agg(F.min("first").alias("following"))
    few = fits(old, ["key"])
    told = with_sessions(old, following, window, few=few).withColumn("open", F.coalesce(F.col("window_end") >= F.col("following"), F.lit(False)))
    state.write(f"open_{name}", young.unionByName(told.where("open").select(*young.columns)))
    closed = told.where("NOT open").groupBy(*GROUP, "value").agg(*merged(functions))
    return finished(closed, functions, few=few)


def count_window_stream(events: DataFrame | Sequence[DataFrame], window: WindowSpec, functions: Sequence[Aggregate], scope: str = "key", lateness_ms: int = LATENESS_MS) -> StreamQuery:
    """(window_id, window_start, window_end, key, value_0, ...) of every ``size`` events, ``slide`` apart, by event time.

    Events wait in a table until the watermark has passed their time; from then on no earlier one can come, and they are
    numbered in the order of event_ts, stream_id and event_id, whatever batch they came in. Later ones are late and dropped.
    In the key scope each key counts its own events; in the global scope all are counted in one order.

    A batch's numbers come from counts of spans of time and from how many events there were before, one row for each key
    (one in all, in the global scope); keys that are all few enough for one task are put in order key by key. Windows
    within what a batch numbers are finished at once. Those that reach beyond it wait as parts, with holistic functions as
    counts of values: no list of a window's events is kept, and no task sees all events of a batch.
    """
    sources = [events] if isinstance(events, DataFrame) else events
    columns = ["event_ts", "stream_id", "event_id", "key", "value"]
    stream = coming(sources, _marked(sources, lateness_ms), columns)
    key = stream.schema["key"] if scope == "key" else StructField("key", LongType(), False)
    seen_before = StructType([key, StructField("before", LongType()), StructField("here", LongType())])

    def finish(rows: DataFrame, state: BatchState) -> DataFrame:
        late, closing = watermarks(rows, state, len(sources), lateness_ms)
        at = F.col("at")
        came = of_events(rows).where(at >= late)
        # of the events that came with the batch before, that batch has numbered those up to what is late now
        before = of_events(state.read(ROWS, rows.schema)).where(at >= late).unionByName(state.read("open", came.schema))
        state.write("open", before.where(at >= closing))
        if closing == late:  # the watermark has not moved: nothing closes
            return state.spark.createDataFrame([], results)
        closed = before.unionByName(came).where(at < closing).drop("at")
        closed = closed if scope == "key" else without_key(closed)
        counts = closed.groupBy("key").agg(F.lit(0).cast("bigint").alias("before"), F.count(F.lit(1)).alias("here"))
        known = state.read("seen", seen_before).withColumns({"before": F.col("before") + F.col("here"), "here": F.lit(0).cast("bigint")})
        seen = state.write("seen", known.unionByName(counts).groupBy("key").agg(F.sum("before").alias("before"), F.sum("here").alias("here")))
        by_key = scope == "key" and (seen.agg(F.max("here")).first()[0] or 0) <= ORDERED
        numbered = numbered_by_key(closed, seen) if by_key else numbered_by_span(closed, seen, ["key"] if scope == "key" else [])
        whole = whole_windows(numbered, window, functions, by_key=by_key)
        border = window_parts(border_windows(numbered, window), functions)
        waiting = state.read("windows", full(border, window).schema).where("NOT full").drop("full")
        parts = waiting.unionByName(border).groupBy("window_start", *kept_by(functions)).agg(F.sum("events").alias("events"), *merged(functions))
        told = state.write("windows", full(parts, window))
        return whole.unionByName(finished(with_ends(told.where("full"), window), functions, few=window.size <= ORDERED))

    results = _results(stream if scope == "key" else without_key(stream), functions)
    return StreamQuery(stream, finish, results, waits=True)
