"""Session windows: events of a key that follow each other within a gap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panemill.functions.aggregates import Aggregate
from panemill.plans.panes import GROUP, few_rows, finished, holistic, kept_by, lifted, merged, same_of
from panemill.plans.spec import WindowSpec

#: Stretches of a range of time, which one task puts in order for a key: a stretch is as long as the gap.
STRETCHES = 1024


def session_windows(events: DataFrame, window: WindowSpec, functions: Sequence[Aggregate], *, keyed: bool = True, few: bool | None = None) -> DataFrame:
    """(window_id, window_start, window_end, key, value_0, ...) of the sessions over the union of all streams.

    A session ends a gap after its last event; an event just a gap later still belongs to it. Events before 0 and those
    without a time are in none. A stream, and a table of ``few`` keyed rows, goes by Spark's own session windows.
    Else all events of a key in one stretch of time as long as the gap are in one session: stretches are summed up before
    the first shuffle, those of 1,024 gaps are put in order by one task, and what goes on over the border of such a range is
    merged from two rows a range at most. Neither a hot key nor events without keys meet in one place. For holistic functions
    different values are counted.
    """
    if events.isStreaming:
        return finished(spark_sessions(events, window, functions), functions, few=True)
    rows = events.where("event_ts >= 0")
    few = few_rows(events) if few is None else few
    if few and keyed and not holistic(functions):
        return finished(spark_sessions(rows, window, functions), functions, few=True)
    return finished(_sessions_by_value(rows, window, functions) if holistic(functions) else _sessions(rows, window, functions), functions, few=few)


def spark_sessions(events: DataFrame, window: WindowSpec, functions: Sequence[Aggregate]) -> DataFrame:
    """The parts of each session, by Spark's session windows."""
    sums = events.where("ts >= timestamp_millis(0)").groupBy(F.session_window("ts", f"{window.size} milliseconds").alias("span"), "key").agg(*lifted(functions))
    return sums.select(F.lit(window.window_id).cast("bigint").alias("window_id"), F.unix_millis("span.start").alias("window_start"), F.unix_millis("span.end").alias("window_end"), *[c for c in sums.columns if c != "span"])


def _stretch(window: WindowSpec) -> Column:
    return F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(window.size))


def _begins(window: WindowSpec, over: Window) -> Column:
    """1 for a row (first, last) that begins a session, 0 for one that goes on with the row before."""
    return F.coalesce((F.col("first") - F.lag("last").over(over) > window.size).cast("long"), F.lit(1))


def _numbered(stretches: DataFrame, window: WindowSpec) -> DataFrame:
    """Add to stretches (key, stretch, first, last, ...) their range of time, and the session's number within it."""
    ranged = stretches.withColumn("range", F.floor(F.col("stretch") / (window.size * STRETCHES)))
    within = Window.partitionBy("key", "range").orderBy("stretch")
    return ranged.withColumn("begins", _begins(window, within)).withColumn("no", F.sum("begins").over(within)).drop("begins")


def _border(within: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sessions of ranges in two tables: those at a range's border, which may go on in the next one, and all others."""
    last = Window.partitionBy("key", "range")
    told = within.withColumn("at_border", (F.col("no") == 1) | (F.col("no") == F.max("no").over(last)))
    return told.where("at_border").drop("at_border"), told.where("NOT at_border").drop("at_border")


def _chained(border: DataFrame, window: WindowSpec) -> DataFrame:
    """Number the sessions of which those at borders are parts."""
    by_key = Window.partitionBy("key").orderBy("first")
    return border.withColumn("begins", _begins(window, by_key)).withColumn("chain", F.sum("begins").over(by_key)).drop("begins")


def _spans(window: WindowSpec) -> list[Column]:
    return [F.lit(window.window_id).cast("bigint").alias("window_id"), F.col("first").alias("window_start"), (F.col("last") + window.size).alias("window_end"), F.col("key")]


def _sessions(rows: DataFrame, window: WindowSpec, functions: Sequence[Aggregate]) -> DataFrame:
    span, parts = [F.min("first").alias("first"), F.max("last").alias("last")], merged(functions)
    names = [c for f, i in zip(functions, range(len(functions)), strict=True) for c in (f"f{i}{p.suffix}" for p in f.parts)]
    stretches = rows.groupBy("key", _stretch(window).alias("stretch")).agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), *lifted(functions))
    border, inner = _border(_numbered(stretches, window).groupBy("key", "range", "no").agg(*span, *parts))
    whole = _chained(border, window).groupBy("key", "chain").agg(*span, *parts)
    return whole.select(*_spans(window), *names).union(inner.select(*_spans(window), *names))


def stretch_spans(stretches: DataFrame, window: WindowSpec) -> DataFrame:
    """(window_id, window_start, window_end, key, stretch) of stretches (key, stretch, first, last): the session of each."""
    numbered = _numbered(stretches, window)
    border, inner = _border(numbered.groupBy("key", "range", "no").agg(F.min("first").alias("first"), F.max("last").alias("last")))
    session = Window.partitionBy("key", "chain")
    whole = _chained(border, window).select("key", "range", "no", F.min("first").over(session).alias("first"), F.max("last").over(session).alias("last"))
    spans = whole.unionByName(inner).select(*_spans(window), "range", "no")
    both = numbered.alias("x").join(spans.alias("y"), same_of(["key", "range", "no"], "x", "y"))
    return both.select("y.window_id", "y.window_start", "y.window_end", "x.key", "x.stretch")


def session_counts(rows: DataFrame, window: WindowSpec, functions: Sequence[Aggregate]) -> DataFrame:
    """(stretch, key, value, first, last, parts): counts of the values of a key in a stretch of time as long as the gap."""
    return rows.groupBy(_stretch(window).alias("stretch"), *kept_by(functions)).agg(F.min("event_ts").alias("first"), F.max("event_ts").alias("last"), *lifted(functions))


def with_sessions(counts: DataFrame, following: DataFrame, window: WindowSpec, *, few: bool) -> DataFrame:
    """Add to ``session_counts`` each one's session (window_id, window_start, window_end) and, of ``following`` (key,
    following), its key's row.

    If there are ``few`` rows of each key, one shuffle by key is all: a session begins where a row's first event comes
    more than a gap after the last event of all rows before. Else see ``stretch_spans``.
    """
    if not few:
        stretches = counts.groupBy("key", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
        both = counts.alias("x").join(stretch_spans(stretches, window).alias("y"), same_of(["key", "stretch"], "x", "y")).select("x.*", "y.window_id", "y.window_start", "y.window_end")
        return both.alias("x").join(following.alias("y"), same_of(["key"], "x", "y"), "left").select("x.*", "y.following")
    by_key = Window.partitionBy("key").orderBy("first")
    upto, session = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("key", "no")
    # the key's row of ``following`` has no first event, so that it stands before all others
    both = counts.unionByName(following, allowMissingColumns=True)
    top = F.max("last").over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumns({"following": F.max("following").over(upto), "begins": F.coalesce((F.col("first") - top > window.size).cast("long"), F.lit(1))})
    told = both.withColumn("no", F.sum("begins").over(upto)).where("first IS NOT NULL")
    spans = {"window_id": F.lit(window.window_id).cast("bigint"), "window_start": F.min("first").over(session), "window_end": F.max("last").over(session) + window.size}
    return told.withColumns(spans).drop("begins", "no")


def _sessions_by_value(rows: DataFrame, window: WindowSpec, functions: Sequence[Aggregate]) -> DataFrame:
    """The parts of each session and value; only counts of different values are joined to sessions."""
    counts = session_counts(rows, window, functions)
    stretches = counts.groupBy("key", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    both = counts.drop("first", "last").alias("x").join(stretch_spans(stretches, window).alias("y"), same_of(["key", "stretch"], "x", "y"))
    spans = both.select("y.window_id", "y.window_start", "y.window_end", "x.*").drop("stretch")
    return spans.groupBy(*GROUP, "value").agg(*merged(functions))
