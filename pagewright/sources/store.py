"""Tables on Parquet: upserts by key, status events, idempotent replacement, content-keyed caches, PDF files."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUSES = ("pending", "vision_done", "tree_uploaded", "enriched", "complete", "failed")
READY_FOR_TREE = ("vision_done", "tree_uploaded", "enriched", "complete")
SEARCHABLE = ("complete", "enriched")
PAST_VISION = ("vision_done", "enriched", "complete")
CACHE_VERSION = "v3"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key, that of new if it has one; rows of new alone are kept too. Of rows that repeat a key in one batch the one with the largest
    values, column by column, counts."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = [F.col(f.name) if f.dataType.typeName() != "map" else F.to_json(f.name) for f in old.schema.fields if f.name not in keys]
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_batch"), *[F.desc_nulls_last(c) for c in rest]))
    return both.withColumn("_n", latest).where("_n = 1").drop("_n", "_batch")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose key it hasn't."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def latest(events: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The last values of each key by time (and by value on ties)."""
    return events.groupBy(key).agg(*[F.max_by(v, F.struct(at, *values)).alias(v) for v in values])


def replace_partitions(df: DataFrame, path: str, by: str = "document_id") -> None:
    """Write df so that the partitions it holds are replaced and all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


_scratch: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own, deleted at exit, only where the session names none and runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        _scratch.append((spark, shared))
    return shared.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted at exit."""
    path = f"{shared_folder(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to a folder of its own and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _scratch:
        try:
            if spark.sparkContext._jsc is not None:
                where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def cache_key(content: Column) -> Column:
    """SHA-256 of the version, a zero byte and the content."""
    return F.sha2(F.concat(F.encode(F.lit(CACHE_VERSION), "utf-8"), F.unhex(F.lit("00")), content.cast("binary")), 256)


def cache_hits(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(cache, key)


def cache_misses(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return rows.join(cache.select(key), key, "left_anti")


def is_pdf(path: Column) -> Column:
    return F.lower(F.coalesce(path, F.lit(""))).endswith(".pdf")


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the PDF files of a folder (extension in any case)."""
    return spark.read.format("binaryFile").load(folder).where(is_pdf(F.col("path"))).select("path", "content")


def page_file_name(number: Column) -> Column:
    return F.format_string("page_%04d.jpg", number)


def render_pages(files: DataFrame, decoder, zoom: float = 2.0) -> DataFrame:
    """document_id, page_number, name, content of each page. decoder(content, zoom) yields the images of a PDF; no PDF library is
    part of this package."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                for n, image in enumerate(decoder(bytes(content), zoom), 1):
                    yield pd.DataFrame({"document_id": [path], "page_number": [n], "content": [image]})

    return files.mapInPandas(run, "document_id string, page_number int, content binary").withColumn("name", page_file_name(F.col("page_number")))


def page_count(rendered: DataFrame) -> DataFrame:
    return rendered.groupBy("document_id").agg(F.max("page_number").alias("page_count"))
