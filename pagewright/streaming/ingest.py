"""Streaming ingestion: new files or records are upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import is_pdf, upsert


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of PDF files as they arrive."""
    return spark.readStream.format("binaryFile").load(folder).where(is_pdf(F.col("path"))).select("path", "content")


def upsert_stream(stream: DataFrame, table: str, keys: list[str], checkpoint: str, trigger: dict | None = None):
    """Start a query that merges each batch into the Parquet table under table. The state after batch n is the folder v<n>, written from v<n-1> and the batch,
    so a batch that is run again writes the same state; versions before v<n-1> are deleted. A batch may repeat keys (see upsert)."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{table}/v{number - 1}"
        new = batch
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(before)
        if number and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            new = upsert(spark.read.parquet(before), batch, keys)
        new.write.mode("overwrite").parquet(f"{table}/v{number}")
        old = jvm.org.apache.hadoop.fs.Path(f"{table}/v{number - 2}")
        store = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if number > 1 and store.exists(old):
            store.delete(old, True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def status_stream(events: DataFrame, key: str, at: str, status: str, late: str = "10 minutes") -> DataFrame:
    """The last status of each key in event time, with a watermark for late events."""
    return events.withWatermark(at, late).groupBy(key).agg(F.max_by(status, at).alias(status))
