"""Incremental job: page records of documents that are new or have changed, from a folder that grows.

A file stream takes the Parquet files that no run has taken (the checkpoint knows them). Of each micro-batch, a page whose cleaned text and language are those stored
already is left out; all others are written as new versions to pages/bucket=<n>/batch=<n>, and totals/bucket=<n> is written anew for the
buckets of documents that the batch touched. A batch that is run again after a failure replaces its own partitions with the same rows: it
compares with earlier batches only. Rows without doc_id can't be told apart later: they go to rejected/batch=<n> as they are.

Of rows of one batch with the same doc_id the one with the greatest digest counts. A null text is an empty page; a null source is a document of its own.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from jobs.common import main
from pagewright.functions.records import page_flags
from pagewright.functions.text import section_numbers, squeeze_newlines, squeeze_spaces, terms
from pagewright.sources.store import cache_key

LOG = logging.getLogger("ingest_pages")
KNOWN = {"buckets": 16, "files_per_batch": 0}
INPUT = "doc_id long, text string, lang string, source string"
PAGE = "doc_id long, document_id string, lang string, digest string, n_words int, n_sections int, low_prose boolean, bucket int, batch long"
TOTAL = "document_id string, pages long, words long, low_prose_pages long, last_batch long, bucket int"


def page_records(docs: DataFrame, buckets: int) -> DataFrame:
    """A page record for each row of docs."""
    text = F.coalesce(squeeze_spaces(squeeze_newlines(F.col("text"))), F.lit(""))
    none = F.array()
    record = docs.select("doc_id", F.col("source").alias("document_id"), "lang", text.alias("text"))
    low_prose = page_flags(F.col("text"), none, none, none, none)[0]
    return record.select(
        "doc_id", "document_id", "lang", cache_key(F.col("text")).alias("digest"), F.size(terms(F.col("text"))).alias("n_words"), F.size(F.array_distinct(section_numbers(F.col("text")))).alias("n_sections"), low_prose.alias("low_prose"),
        F.pmod(F.crc32(F.coalesce("document_id", F.lit("")).cast("binary")), F.lit(buckets)).cast("int").alias("bucket"),
    )


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:  # nothing was written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def current(spark: SparkSession, output: str) -> DataFrame:
    """The last version of each page."""
    rows = _stored(spark, f"{output}/pages", PAGE)
    columns = [c for c in rows.columns if c != "doc_id"]
    return rows.groupBy("doc_id").agg(F.max_by(F.struct(*columns), "batch").alias("v")).select("doc_id", "v.*")


def totals(spark: SparkSession, output: str) -> DataFrame:
    return _stored(spark, f"{output}/totals", TOTAL)


def ingest(batch: DataFrame, number: int, output: str, buckets: int) -> None:
    """Write what is new in a micro-batch."""
    spark = batch.sparkSession
    read, new = Observation(f"read {number}"), Observation(f"new {number}")
    rows = F.count(F.lit(1)).alias("rows")
    taken = batch.observe(read, rows, F.count_if(F.col("doc_id").isNull()).alias("rejected")).where("doc_id is not null")
    records = page_records(taken, buckets)
    order = F.struct("digest", F.coalesce("lang", F.lit("")), F.coalesce("document_id", F.lit("")))
    records = records.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in records.columns if c != "doc_id"]), order).alias("v")).select("doc_id", "v.*")
    before = _stored(spark, f"{output}/pages", PAGE).where(F.col("batch") < number)
    before = before.groupBy("doc_id").agg(F.max_by(F.struct("digest", "lang", "document_id"), "batch").alias("old"))
    same = F.col("digest").eqNullSafe(F.col("old.digest")) & F.col("lang").eqNullSafe(F.col("old.lang")) & F.col("document_id").eqNullSafe(F.col("old.document_id"))
    changed = records.join(before, "doc_id", "left").where(F.col("old").isNull() | ~same)
    changed = changed.drop("old").withColumn("batch", F.lit(number).cast("long")).observe(new, rows)
    _replace(changed, f"{output}/pages", "bucket", "batch")
    if read.get["rejected"]:
        _replace(batch.where("doc_id is null").withColumn("batch", F.lit(number).cast("long")), f"{output}/rejected", "batch")
    LOG.info("batch %d: read %d rows, wrote %d page versions to %s/pages, rejected %d", number, read.get["rows"], new.get["rows"], output, read.get["rejected"])
    _total(spark, number, output)


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows; of what lies under path, only their own partitions are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def _total(spark: SparkSession, number: int, output: str) -> None:
    """Totals of all documents in the buckets that batch number wrote pages to, or took pages from. A document that has lost its pages stays, with none."""
    rows = _stored(spark, f"{output}/pages", PAGE).where(F.col("batch") <= number)
    own = rows.where(F.col("batch") == number).select("doc_id")
    changed = [r["bucket"] for r in rows.join(own, "doc_id", "left_semi").select("bucket").distinct().collect()]  # at most so many rows as there are buckets
    last = rows.groupBy("doc_id").agg(F.max("batch").alias("last"))
    now = F.col("batch") == F.col("last")
    each = rows.where(F.col("bucket").isin(changed)).join(last, "doc_id").groupBy("document_id", "bucket").agg(
        F.count_if(now).alias("pages"), F.coalesce(F.sum(F.when(now, F.col("n_words").cast("long"))), F.lit(0)).alias("words"), F.count_if(now & F.col("low_prose")).alias("low_prose_pages"), F.max("batch").alias("last_batch")
    )
    _replace(each, f"{output}/totals", "bucket")
    LOG.info("batch %d: wrote totals of %d buckets to %s/totals", number, len(changed), output)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict = KNOWN) -> DataFrame:
    """Take what is new under documents (a folder, or a pattern of folders or files) into output, then stop. Returns all pages as they stand, with the totals of their documents."""
    config = KNOWN | config
    LOG.info("taking new files of %s, checkpoint %s, settings %s", documents, checkpoint, config)
    stream = spark.readStream.schema(INPUT)
    if config["files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["files_per_batch"])
    query = (
        stream.parquet(documents)
        .writeStream.foreachBatch(lambda batch, number: ingest(batch, number, output, config["buckets"]))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    pages, sums = current(spark, output), totals(spark, output).where("pages > 0")
    LOG.info("%s holds %d pages of %d documents", output, pages.count(), sums.count())
    sums = sums.select(F.col("document_id").alias("of"), "pages", "words", "low_prose_pages")
    return pages.drop("bucket", "batch").join(sums, F.col("document_id").eqNullSafe(F.col("of"))).drop("of")


if __name__ == "__main__":
    main("ingest_pages", run, {"documents": "folder of Parquet files with doc_id, text, lang and source, or a pattern of such", "output": "folder of the pages", "checkpoint": "folder of the stream's checkpoint"}, KNOWN)
