"""Windows without events: one row for every key and window, with null values where nothing fell in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panemill.plans.spec import WindowSpec


def with_empty_windows(results: DataFrame, window: WindowSpec) -> DataFrame:
    """Fill a fixed time window's results (window_start, key, ...) for each key from the first to the last window.

    The first and last window of all results go to all rows as one broadcast row. Each result row gives the windows
    without events that follow it, a key's first one also those before it.
    """
    bounds = results.agg(F.min("window_start").alias("first"), F.max("window_start").alias("last"))
    by_key = Window.partitionBy("key").orderBy("window_start")
    rows = results.withColumns({"before": F.lag("window_start").over(by_key), "after": F.lead("window_start").over(by_key)}).join(F.broadcast(bounds))
    step = f"CAST({window.slide} AS BIGINT)"

    def between(first: str, end: str) -> str:
        return f"CASE WHEN {first} < {end} THEN sequence({first}, {end} - {step}, {step}) ELSE array() END"

    starts = f"concat(CASE WHEN before IS NULL THEN {between('first', 'window_start')} ELSE array() END, array(window_start), {between(f'window_start + {step}', f'coalesce(after, last + {step})')})"
    filled = rows.withColumn("start", F.explode(F.expr(starts)))
    values = [F.when(F.col("start") == F.col("window_start"), F.col(c)).alias(c) for c in results.columns if c.startswith("value_")]
    return filled.select(F.lit(window.window_id).cast("bigint").alias("window_id"), F.col("start").alias("window_start"), (F.col("start") + window.size).alias("window_end"), "key", *values)
