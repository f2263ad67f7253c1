"""Folders and tables that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    Where spark.checkpoint.dir is unset, a temporary folder takes its place on a single machine, and only there.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-stream-")
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table in the shared folder and read it again: what it holds stays as it is, whatever is lost later."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def file_system(spark: SparkSession, folder: str) -> tuple[Any, Any]:
    """The folder as a path and the file system that holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where it does not exist."""
    path, files = file_system(spark, folder)
    return [str(x.getPath().getName()) for x in files.listStatus(path)] if files.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    path, files = file_system(spark, folder)
    files.delete(path, True)
