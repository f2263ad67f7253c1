import time

from pyspark.sql import functions as F

from panemill.streaming.progress import Batch, ProgressLog, falls_behind


def test_progress_of_a_stream(spark, tmp_path):
    log = ProgressLog()
    spark.streams.addListener(log)
    try:
        spark.range(100).coalesce(1).write.parquet(f"{tmp_path}/in")
        query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").where(F.col("id") % 2 == 0).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        until = time.time() + 20
        while not log.batches and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sum(b.rows for b in log.batches) == 100
    assert log.rows_per_second(log.batches[0].query) > 0 and log.rows_per_second("other") == 0


def test_falling_behind():
    def batch(rows, came, done):
        return Batch("q", 0, rows, came, done, 1, None)

    slow, fast, empty = batch(5, 9.0, 8.0), batch(5, 8.0, 9.0), batch(0, 0.0, 0.0)
    assert falls_behind([fast, slow, empty, slow, slow], 3)
    assert not falls_behind([slow, slow, fast, slow], 3) and not falls_behind([slow, slow], 3)
