"""What a stream's micro-batches hand on: tables in the stream's shared folder, one version for each batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from panemill.sources.shared import delete, names_in


@dataclass
class BatchState:
    """The tables of one micro-batch.

    A batch reads the versions of the batches before and writes its own. A batch that is run again after a failure reads
    the same versions and writes its own anew, so that nothing counts twice. Tables are Parquet files: they grow with what is
    open in the stream, are dealt over tasks like any table, and survive lost executors and the driver.
    """

    spark: SparkSession
    folder: str
    batch: int
    read_versions: dict[str, int] = field(default_factory=dict)

    def _versions(self, name: str) -> list[int]:
        return sorted(int(x) for x in names_in(self.spark, f"{self.folder}/{name}") if x.isdigit())

    def read(self, name: str, schema: StructType) -> DataFrame:
        """The table as the last batch before left it; empty at first."""
        before = [v for v in self._versions(name) if v < self.batch]
        if not before:
            return self.spark.createDataFrame([], schema)
        self.read_versions[name] = before[-1]
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/{before[-1]}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        """Write this batch's version and return what is in it."""
        path = f"{self.folder}/{name}/{self.batch}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def tidy(self) -> None:
        """Delete versions that no batch reads any more: those before the one that this batch has read, or before the last."""
        for name in names_in(self.spark, self.folder):
            versions = self._versions(name)
            keep = self.read_versions.get(name, versions[-1] if versions else 0)
            for version in versions:
                if version < keep:
                    delete(self.spark, f"{self.folder}/{name}/{version}")


@dataclass(frozen=True)
class StreamQuery:
    """A stream of rows that come out as the watermark closes them, and what makes results of a micro-batch of these.

    ``finish`` works on a bounded table, so that everything a bounded query can do is open to it. ``results`` are the
    columns of what it returns. ``waits``: rows come out at once and wait in tables, so that a batch without rows has results
    as well.
    """

    rows: DataFrame
    finish: Callable[[DataFrame, BatchState], DataFrame]
    results: StructType
    waits: bool = False
