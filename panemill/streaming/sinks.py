"""Run a stream over what is there now and give the result as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from panemill.sources.shared import names_in, shared_folder
from panemill.streaming.state import BatchState, StreamQuery
from panemill.streaming.waiting import ROWS


def drained(stream: DataFrame | StreamQuery, folder: str | None = None) -> DataFrame:
    """Append all that the stream's sources hold to files in a shared folder, then read them.

    State and progress are checkpointed in the same folder: a second run with the folder of a first one goes on where it
    stopped. Windows that the watermark has not passed stay open and are not in the result; closing marks in the sources lift
    it past them (``write_end``).
    """
    if isinstance(stream, StreamQuery):
        return _finished(stream, folder or shared_folder(stream.rows.sparkSession))
    base = folder or shared_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def _finished(stream: StreamQuery, base: str) -> DataFrame:
    """Each batch's rows are written once, then finished; its results replace those of an earlier attempt.

    Tables are read by the caller's session: the one that runs a stream's batches does without adaptive plans, so that each
    step would have as many tasks as the stream's state has parts.
    """
    spark = stream.rows.sparkSession

    def finish(batch: DataFrame, number: int) -> None:
        state = BatchState(spark, f"{base}/tables", number)
        rows = state.write(ROWS, batch)
        if stream.waits or not rows.isEmpty():
            stream.finish(rows, state).write.mode("overwrite").parquet(f"{base}/out/{number}")
        state.tidy()

    writer = stream.rows.writeStream.foreachBatch(finish).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    query = _with_one_part(spark, writer) if stream.waits else writer.start()
    query.awaitTermination()
    found = [f"{base}/out/{x}" for x in names_in(spark, f"{base}/out")]
    return spark.read.schema(stream.results).parquet(*found) if found else spark.createDataFrame([], stream.results)


def _with_one_part(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a stream whose state is a few rows: one part of it is enough. A stream keeps the settings that it began with."""
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        return writer.start()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
