"""A query over events: windows of every kind, all functions, as one table."""

from __future__ import annotations

from functools import reduce
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panemill.operators.count_windows import count_windows, without_key
from panemill.operators.dense import with_empty_windows
from panemill.operators.sessions import session_windows
from panemill.plans.panes import few_rows, fixed_windows, holistic
from panemill.plans.spec import QuerySpec


def wide_results(events: DataFrame, query: QuerySpec, *, dense: bool = False) -> DataFrame:
    """(window_id, window_start, window_end, key, value_0, ...): one row for a window and key, a column for a function.

    ``dense`` adds rows for fixed windows in which a key has no events.
    """
    functions, parts = query.functions, []
    fixed = query.fixed()
    if not query.keyed:
        events = without_key(events)
    # the only thing that is asked before the plan stands: whether a group can be too large for one task
    few = few_rows(events) if holistic(functions) or (query.sessions() and query.keyed) else False
    if fixed and dense:
        parts += [with_empty_windows(fixed_windows(events, [w], functions, gcd(w.size, w.slide), few=few), w) for w in fixed]
    elif fixed:
        parts.append(fixed_windows(events, fixed, functions, query.pane_ms(), few=few))
    parts += [session_windows(events, w, functions, keyed=query.keyed, few=few) for w in query.sessions()]
    parts += [count_windows(events, w, functions, query.count_scope) for w in query.counts()]
    return reduce(DataFrame.unionByName, parts)


def long_results(wide: DataFrame) -> DataFrame:
    """One row for a window, key and function: (window_id, window_start, window_end, function_id, key, value)."""
    values = F.array(*[c for c in wide.columns if c.startswith("value_")])
    rows = wide.select("window_id", "window_start", "window_end", "key", F.posexplode(values).alias("function_id", "value"))
    return rows.select("window_id", "window_start", "window_end", "function_id", "key", "value")


def run(events: DataFrame, query: QuerySpec, *, dense: bool = False) -> DataFrame:
    """The results of a query, one row for each window, key and function."""
    return long_results(wide_results(events, query, dense=dense))


def run_text(events: DataFrame, windows: str, functions: str, **options: bool) -> DataFrame:
    """The results of a query in text form."""
    return run(events, QuerySpec.parse(windows, functions), **options)
