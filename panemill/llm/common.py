"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word is a run of anything but a space and the control characters 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of a batch that goes to a Python worker: Spark's own bound of 64 MB is held in several copies.
BATCH = "8m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that this session sends to Python workers by bytes, whatever the rows hold."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def give_back() -> None:
    """Return freed memory to the system: Spark's workers live on, and each next task's arrays have other sizes."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has this call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and leave every other letter alone."""
    return F.translate(text, UPPER, UPPER.lower())


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and where each value starts (one more entry for the end).

    Nulls count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if binary else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    starts = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    starts = starts.astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, text: int, size: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``size`` bytes of the text column at this place; each has a row at least.

    Work on arrays takes a hundred bytes and more for each byte of text: slices bound it, whatever the batch holds.
    """
    _, at = utf8(batch.column(text))
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(at, at[first] + size)) - 1)
        yield batch.slice(first, last - first)
        first = last


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where spark.checkpoint.dir is unset, a temporary folder takes its place on a single machine (as in tests); on a
    cluster, whose machines don't share such a folder, that is refused.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        context.setCheckpointDir(root)
    return f"{root.rstrip('/')}/panemill-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it again: its lineage ends there and survives lost executors."""
    return Scratch(df.sparkSession).written(df, name)


class Scratch:
    """Tables of one job in the shared folder. What a job has done with can be dropped before the job's end."""

    def __init__(self, spark: SparkSession) -> None:
        bounded_batches(spark)
        self.spark, self.folder = spark, shared_folder(spark)
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(self.folder + "/checkpoints")

    def written(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of ids up to which a table may be broadcast: some 16 to 40 MB.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """Count a table and mark it for a broadcast if it has no more than a million rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def keep_columns(df: DataFrame, taken: tuple[str, ...], within: str | None = None) -> list[Column]:
    """The columns of ``df`` but for those whose names an operator needs for its own results.

    ``within`` names a struct column that holds the row, so that no helper column can clash with the row's own.
    """
    names = [c for c in df.columns if c.lower() not in {t.lower() for t in taken}]
    return [(F.col(within).getField(c) if within else F.col(f"`{c}`")).alias(c) for c in names]
