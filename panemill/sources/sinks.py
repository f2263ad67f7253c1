"""Result sinks: files, the console, and the text form of a result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_text_id(results: DataFrame, node_id: int = -1) -> DataFrame:
    """Add result_id ``window,start,end,function,node,key`` and result_text, where a null value reads ``null``."""
    ident = F.concat_ws(",", "window_id", "window_start", "window_end", "function_id", F.lit(node_id), "key")
    return results.withColumns({"result_id": ident, "result_text": F.coalesce(F.col("value").cast("string"), F.lit("null"))})


def without_empty(results: DataFrame) -> DataFrame:
    """Leave out windows without a value."""
    return results.where("value IS NOT NULL")


def with_latency(results: DataFrame, now_ms: int | None = None) -> DataFrame:
    """Add latency_ms: the time since a value that is a wall time."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms)
    return without_empty(results).withColumn("latency_ms", now - F.col("value"))


def write_results(results: DataFrame, path: str, *, checkpoint: str | None = None) -> StreamingQuery | None:
    """Write results as Parquet; a stream is appended to until it ends, and its query is returned."""
    if not results.isStreaming:
        results.write.mode("overwrite").parquet(path)
        return None
    return results.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint or path + "-checkpoint").trigger(availableNow=True).start()


def print_results(results: DataFrame) -> StreamingQuery:
    """Print a stream's results, without the empty ones."""
    return without_empty(results).writeStream.format("console").outputMode("append").start()
