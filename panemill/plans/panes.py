"""Pane sharing: all fixed time windows of a query over one set of partial aggregates.

Spark's ``window(ts, size, slide)`` copies each row for each window before it aggregates, and several windows read the
input several times. Here rows are aggregated once, into panes as long as all sizes and slides have in common;
only panes are copied to the windows that they lie in. That costs a shuffle of no more rows than there are events; where an
event lies in few windows, it is copied instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panemill.functions.aggregates import Aggregate
from panemill.plans.spec import WindowSpec
from panemill.sources.shared import written

GROUP = ("window_id", "window_start", "window_end", "key")
#: Windows that an event lies in from which on panes are worth a shuffle: they add a quarter to it at most.
COPIES = 4
#: Rows that one task may put in order.
ORDERED = 1_000_000


def holistic(functions: Sequence[Aggregate]) -> bool:
    return any(f.kind == "holistic" for f in functions)


def lifted(functions: Sequence[Aggregate]) -> list[Column]:
    """What a group of events keeps: with holistic functions, for which events are grouped by value too, also a count."""
    count = [F.count("value").alias("n")] if holistic(functions) else []
    return count + [c for i, f in enumerate(functions) for c in f.lifted(F.col("value"), f"f{i}")]


def merged(functions: Sequence[Aggregate]) -> list[Column]:
    count = [F.sum("n").alias("n")] if holistic(functions) else []
    return count + [c for i, f in enumerate(functions) for c in f.merged(f"f{i}")]


def kept_by(functions: Sequence[Aggregate]) -> list[str]:
    """By what events are grouped besides their window."""
    return ["key", "value"] if holistic(functions) else ["key"]


def same_of(columns: Sequence[str], left: str, right: str) -> Column:
    """Whether two aliased tables agree in some columns; null agrees with null."""
    return F.expr(" AND ".join(f"{left}.{c} <=> {right}.{c}" for c in columns))


def windows_over(start: Column, windows: Sequence[WindowSpec]) -> Column:
    """The windows (window_id, window_start, window_end) that a pane or event at ``start`` lies in; none begins before 0."""
    return F.when(start >= 0, F.concat(*[_windows_of(start, w) for w in windows]))


def _windows_of(start: Column, w: WindowSpec) -> Column:
    last = start - F.pmod(start, F.lit(w.slide))
    first = F.greatest(last - F.lit((w.size - 1) // w.slide * w.slide), F.lit(0))
    starts = F.sequence(first, last, F.lit(w.slide).cast("bigint"))
    if w.size % w.slide:
        # the first candidate may end at or before the event
        starts = F.filter(starts, lambda s: s + w.size > start)
    return F.transform(starts, lambda s: F.struct(F.lit(w.window_id).cast("bigint").alias("window_id"), s.alias("window_start"), (s + w.size).alias("window_end")))


def panes_pay(windows: Sequence[WindowSpec]) -> bool:
    """Whether an event lies in so many windows that it should be summed up in a pane before it is copied."""
    return sum(-(-w.size // w.slide) for w in windows) >= COPIES


def in_windows(events: DataFrame, windows: Sequence[WindowSpec], pane_ms: int, functions: Sequence[Aggregate], *, share: bool) -> DataFrame:
    """(window_id, window_start, window_end, key, value for holistic functions, parts) of all events from 0 on."""
    rows, by = events.where("event_ts >= 0"), kept_by(functions)
    if len(windows) == 1 and windows[0].size == windows[0].slide:
        # one tumbling window: its panes are the windows
        w = windows[0]
        start = F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(w.size))
        found = rows.select("key", "value", start.alias("window_start")).groupBy("window_start", *by).agg(*lifted(functions))
        return found.select(F.lit(w.window_id).cast("bigint").alias("window_id"), (F.col("window_start") + w.size).alias("window_end"), "*")
    if not share:
        copies = rows.select("key", "value", F.explode(windows_over(F.col("event_ts"), windows)).alias("w")).select("w.*", "key", "value")
        return copies.groupBy("window_id", "window_start", "window_end", *by).agg(*lifted(functions))
    pane = F.col("event_ts") - F.pmod(F.col("event_ts"), F.lit(pane_ms))
    panes = rows.select("key", "value", pane.alias("pane_start")).groupBy("pane_start", *by).agg(*lifted(functions))
    copies = panes.withColumn("w", F.explode(windows_over(F.col("pane_start"), windows))).select("w.*", "*")
    return copies.groupBy("window_id", "window_start", "window_end", *by).agg(*merged(functions))


def few_rows(rows: DataFrame) -> bool:
    """Whether no group of these rows can be too large for one task. Of files, only the rows' number is read."""
    return rows.count() <= ORDERED


def fits(rows: DataFrame, by: Sequence[str]) -> bool:
    """Whether one task may put each group of these rows in order, judged by how many rows the largest one has."""
    return few_rows(rows) or (rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= ORDERED


def placed(counts: DataFrame, *, few: bool, beside: Sequence[str] = ()) -> DataFrame:
    """Add to counts of values (GROUP, value, n, ...) how many values there are up to each one, and how many in all.

    If there are ``few`` rows, each group is put in order by one task. Else all rows are dealt to ranges of (group, value)
    that hold equally many: Spark takes the ranges' borders from a sample, so that neither a hot group nor values that
    crowd make one range larger. Running sums over the ranges of a group and within a range make up a value's place.
    The dealt rows are written, since another sample would deal them differently. ``beside``: columns that follow from the
    group, by which few rows are dealt already.
    """
    if few:
        group = Window.partitionBy(*GROUP, *beside)
        return counts.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})
    group = Window.partitionBy(*GROUP)
    counts = written(counts)  # else the sample and the rows' number would each work them out again
    ranges = max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), counts.count() // ORDERED + 1)
    dealt = written(counts.repartitionByRange(ranges, *GROUP, "value").withColumn("range", F.spark_partition_id()))
    sums = dealt.groupBy(*GROUP, "range").agg(F.sum("n").alias("here"))
    sums = sums.withColumns({"below": F.sum("here").over(group.orderBy("range")) - F.col("here"), "total": F.sum("here").over(group)})
    both = dealt.alias("x").join(sums.alias("y"), same_of([*GROUP, "range"], "x", "y")).select("x.*", "y.below", "y.total")
    return both.withColumn("upto", F.col("below") + F.sum("n").over(Window.partitionBy(*GROUP, "range").orderBy("value")))


def finished(rows: DataFrame, functions: Sequence[Aggregate], *, few: bool, beside: Sequence[str] = ()) -> DataFrame:
    """Results (GROUP, value_0, ...) of rows that hold a window's parts, or with holistic functions those of each value.

    All functions come from one grouping: the counts give the holistic ones, the values' parts merge to all others.
    """
    if holistic(functions):
        columns = [F.col(c) for c in ("value", "n", "upto", "total")]
        counted = [f.over_counts(*columns).alias(f"f{i}") for i, f in enumerate(functions) if f.kind == "holistic"]
        parts = [c for i, f in enumerate(functions) for c in f.merged(f"f{i}")]
        rows = placed(rows, few=few, beside=beside).groupBy(*GROUP, *(beside if few else ())).agg(*counted, *parts)
    values = [F.col(f"f{i}") if f.kind == "holistic" else f.lowered(f"f{i}") for i, f in enumerate(functions)]
    return rows.select(*GROUP, *[v.cast("bigint").alias(f"value_{i}") for i, v in enumerate(values)])


def fixed_windows(events: DataFrame, windows: Sequence[WindowSpec], functions: Sequence[Aggregate], pane_ms: int, *, share: bool | None = None, few: bool | None = None) -> DataFrame:
    """(window_id, window_start, window_end, key, value_0, ...) of tumbling and sliding time windows.

    Events are read once. With a holistic function they are grouped by value as well: counts of different values and
    the other functions' parts go through the same shuffles, summed up before each one. ``share``: whether to go by panes;
    where it is left out, the number of windows that an event lies in tells. ``few``: see ``placed``. A group whose values
    are all null has a result of nulls.
    """
    rows = in_windows(events, windows, pane_ms, functions, share=panes_pay(windows) if share is None else share)
    if few is None:
        few = not holistic(functions) or few_rows(events)
    return finished(rows, functions, few=few)
