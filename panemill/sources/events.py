"""Event sources: rows (stream_id int, event_ts long in ms, value long, key long) with ts as a timestamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The key of events without one.
NO_KEY = -2
COLUMNS = ("stream_id", "event_ts", "value", "key", "event_id")


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.timestamp_millis("event_ts"))


def as_events(df: DataFrame) -> DataFrame:
    """The driver's event table as events: the user is the key, and ids are dealt over four streams.

    The millisecond is the floor of the microseconds; the value is the floor of the number.
    """
    return _timed(df.select((F.col("event_id") % 4).cast("int").alias("stream_id"), F.expr("unix_millis(cast(ts as timestamp))").alias("event_ts"), F.floor("value").cast("bigint").alias("value"), F.coalesce(F.col("user_id"), F.lit(NO_KEY)).cast("bigint").alias("key"), "event_id"))


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def read_event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a stream of files; ``files_per_trigger`` bounds what a micro-batch takes in."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return as_events(reader.parquet(path + "*"))


def decode_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines ``stream,ts,value[,key]`` as events; a malformed number raises, as ANSI casts do."""
    parts = F.split(F.col(column), ",")
    rows = lines.select(parts[0].cast("int").alias("stream_id"), parts[1].cast("bigint").alias("event_ts"), parts[2].cast("bigint").alias("value"), F.coalesce(F.try_element_at(parts, F.lit(4)).cast("bigint"), F.lit(NO_KEY).cast("bigint")).alias("key"))
    return _timed(rows.withColumn("event_id", F.monotonically_increasing_id()))


def union_streams(*streams: DataFrame) -> DataFrame:
    """All events of several streams."""
    found, *rest = streams
    for stream in rest:
        found = found.unionByName(stream, allowMissingColumns=True)
    return found


def write_batch(events: DataFrame, folder: str, files: int = 1) -> None:
    """Add events to a folder that a stream reads, as so many files."""
    events.drop("ts").repartition(files).write.mode("append").parquet(folder)


def write_end(spark: SparkSession, folder: str, at_ms: int) -> None:
    """Add a closing mark to a folder that a stream reads: no event, but a time that lifts the source's watermark.

    Of several sources the slowest one's watermark counts, so that each needs a mark past the last window of all.
    """
    spark.range(1).select(F.lit(at_ms).cast("bigint").alias("event_ts"), F.lit(True).alias("ends")).write.mode("append").parquet(folder)


def batch_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """The events of a folder as a stream that takes in so many files at a time, the oldest first.

    ``ends`` tells closing marks, which ``watermarked`` leaves out.
    """
    schema = "stream_id int, event_ts bigint, value bigint, key bigint, event_id bigint, ends boolean"
    return _timed(spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder))
