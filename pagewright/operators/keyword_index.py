"""A keyword index of blocks with maxima: what a search needs not to read most postings.

Rows are numbered by id. The postings of a term lie in blocks of ``width`` consecutive numbers, so a term that every row has is many rows of bounded size,
not one. A block knows the largest weight that it can add to a score (block-max, Ding and Suel 2011). A search reads the headers of its
terms' blocks, scores the few most promising blocks whole, and then only those whose bound reaches the k-th score found (MaxScore, Turtle and
Flood 1995). Results are those of the exhaustive lane, ties by id included.

A row without terms has a number and no posting. Rows without id are left out; rows that repeat an id count as one with all their words.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import terms
from ..sources import store
from .retrieval import K1, B

WIDTH = 4096
#: Words of a part of a build, and its most parts: beyond that they grow. A part is a task's, whose blocks are sorted in memory.
PART_WORDS, MOST_PARTS = 1_000_000, 4096
POSTINGS = "array<struct<doc:long,tf:int,n:long>>"


@dataclass(frozen=True)
class KeywordIndex:
    """blocks: bucket, term, block, n_docs, n_words, peak, postings (doc, tf, n), by term and block; words: term, df, peak; rows: doc, id, n; stats: n_docs, mean, width."""

    blocks: DataFrame
    words: DataFrame
    rows: DataFrame
    stats: DataFrame

    def write(self, path: str) -> KeywordIndex:
        """Replace what lies under path (blocks in folders by bucket) and read it back."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.stats.write.mode("overwrite").json(f"{path}/stats")
        # blocks stay where they were made: each file is sorted by term, so that a search reads few row groups of it, and no posting is shuffled
        buckets = self.blocks.sortWithinPartitions("bucket", "term", "block")
        buckets.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        spark = self.blocks.sparkSession
        _words(_read_blocks(spark, path)).write.mode("overwrite").parquet(f"{path}/words")
        return read(spark, path)


def _read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"term string, block long, n_docs long, n_words long, peak double, postings {POSTINGS}, bucket int").parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str) -> KeywordIndex:
    stats = spark.read.schema("n_docs long, mean double, width long, buckets int").json(f"{path}/stats")
    return KeywordIndex(_read_blocks(spark, path), spark.read.parquet(f"{path}/words"), spark.read.parquet(f"{path}/rows"), stats)


def weight(tf, n, mean):
    """What a term with an idf of 1 adds to a row's score; of columns or arrays."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / mean))


def _words(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("peak").alias("peak"))


def numbered(ids: DataFrame, column: str = "id") -> DataFrame:
    """ids (distinct) with doc, their number (from 0) in the order of column: ranges are counted, then numbered within; no task sees all rows."""
    spread = store.written(ids.repartitionByRange(column).withColumn("part", F.spark_partition_id()), "spread")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    counts = spread.groupBy("part").agg(F.count("*").alias("_n"))
    counts = counts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(column))
    return spread.withColumn("_own", own).join(F.broadcast(counts), "part").withColumn("doc", F.col("_before") + F.col("_own") - 1).drop("part", "_own", "_before")


def build(chunks: DataFrame, analyzer=terms, text: str = "search_text", width: int = WIDTH, buckets: int = 16) -> KeywordIndex:
    """The index of chunks (id and text). buckets bounds the folders that terms are dealt to."""
    spark = chunks.sparkSession
    words = chunks.where("id is not null").select("id", analyzer(F.col(text)).alias("w"))
    rows = store.written(numbered(words.groupBy("id").agg(F.sum(F.size("w")).alias("n"))).select("doc", "id", "n"), "rows")
    s = rows.agg(F.count("*").alias("n_docs"), F.avg("n").alias("mean")).first()
    stats = spark.range(1).select(F.lit(s["n_docs"]).cast("long").alias("n_docs"), F.lit(float(s["mean"] or 1.0)).alias("mean"), F.lit(width).cast("long").alias("width"), F.lit(buckets).alias("buckets"))
    # texts, smaller than their postings, are shuffled once: a part is a range of ids that holds whole blocks
    total = (s["n_docs"] or 0) * float(s["mean"] or 0)
    parts = min(MOST_PARTS, max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // PART_WORDS)))
    each = width * max(1, -(-s["n_docs"] // (width * parts)))
    starts = [r["id"] for r in rows.where(F.col("doc") % each == 0).orderBy("doc").select("id").collect()]  # an id for each part
    part = F.size(F.filter(F.array(*[F.lit(x) for x in starts]), lambda x: x <= F.col("id"))) - 1 if starts else F.lit(0)
    dealt = chunks.where("id is not null").select("id", F.col(text).alias("_text")).withColumn("part", part).repartition(max(1, len(starts)), "part")
    doc = F.col("part").cast("long") * each + F.dense_rank().over(Window.partitionBy("part").orderBy("id")) - 1
    own = dealt.withColumn("doc", doc).select("part", "id", "doc", analyzer(F.col("_text")).alias("w"))
    # a task's rows come by number, so each block is counted alone; neither words nor postings are rows that Spark would have to hash and sort
    counted = block_maker(width, float(s["mean"] or 1.0))
    blocks = own.sortWithinPartitions("part", "id").select("doc", "w").mapInArrow(counted, f"term string, block long, n_docs long, n_words long, peak double, postings {POSTINGS}")
    blocks = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets))
    return KeywordIndex(blocks, _words(blocks), rows, stats)


def block_maker(width: int, mean: float):
    """The blocks of rows of doc and w (list of terms) that come by doc, as a function for mapInArrow. It holds the rows of the batch at hand and of the block that it ends in."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            block = batch.column(0).to_numpy() // width
            if held[0].column(0)[0].as_py() // width == block[-1]:
                continue
            whole = int(np.searchsorted(block, block[-1]))  # the last block may go on in the next batch
            held[-1] = batch.slice(0, whole)
            yield from _blocks(held, width, mean)
            held = [batch.slice(whole)]
        if held:
            yield from _blocks(held, width, mean)

    return run


def _blocks(rows: list[pa.RecordBatch], width: int, mean: float):
    table = pa.Table.from_batches(rows)
    lists = table.column(1).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.diff(lists.offsets.to_numpy())
    docs, row = np.unique(table.column(0).to_numpy(), return_inverse=True)  # rows that repeat an id have one number
    n = np.bincount(row, weights=lengths, minlength=len(docs)).astype(np.int64)
    terms = lists.flatten().dictionary_encode()
    if not len(terms):
        return
    keys, tf = np.unique(terms.indices.to_numpy().astype(np.int64) * len(docs) + np.repeat(row, lengths), return_counts=True)
    term, at = np.divmod(keys, len(docs))
    doc, n = docs[at], n[at]
    block = doc // width
    starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[starts, len(keys)].astype(np.int32)
    postings = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([doc, tf.astype(np.int32), n], ["doc", "tf", "n"]))
    columns = {
        "term": terms.dictionary.take(pa.array(term[starts])),
        "block": block[starts],
        "n_docs": np.diff(ends).astype(np.int64),
        "n_words": np.add.reduceat(tf, starts).astype(np.int64),
        "peak": np.maximum.reduceat(weight(tf.astype(np.float64), n, mean), starts),
        "postings": postings,
    }
    yield from pa.table(columns).to_batches(max_chunksize=10_000)


def bucket_of(term: Column, buckets: int | Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def search(index: KeywordIndex, query: str, k: int, analyzer=terms, first: int = 4) -> DataFrame:
    """id and score of the k best rows that have every term of query, by BM25. The statistics of the query's terms and the k-th score of the first blocks are
    the only values that the driver sees."""
    return _search(index, query, k, analyzer, first)[0]


def _search(index: KeywordIndex, query: str, k: int, analyzer=terms, first: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """The result, and the block headers that were scored (block, bound, n)."""
    spark = index.blocks.sparkSession
    asked = spark.range(1).select(F.array_distinct(analyzer(F.lit(query))).alias("t")).first()["t"]
    nothing = index.rows.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    if not asked:
        return nothing, None
    stats = index.stats.first()
    known = {r["term"]: r["df"] for r in index.words.where(F.col("term").isin(asked)).select("term", "df").collect()}  # a row for each term of the query
    if len(known) < len(asked):
        return nothing, None
    idf = {t: float(np.log(1 + (stats["n_docs"] - known[t] + 0.5) / (known[t] + 0.5))) for t in asked}
    buckets = [r["b"] for r in spark.createDataFrame([(t,) for t in asked], "t string").select(bucket_of(F.col("t"), stats["buckets"]).alias("b")).distinct().collect()]
    own = index.blocks.where(F.col("bucket").isin(buckets) & F.col("term").isin(asked))
    own = own.withColumn("idf", reduce(lambda e, t: e.when(F.col("term") == t, F.lit(idf[t])), asked, F.when(F.lit(False), F.lit(0.0))))
    bounds = own.groupBy("block").agg(F.count("*").alias("terms"), F.sum(F.col("idf") * F.col("peak")).alias("bound"), F.sum("n_docs").alias("n"))
    bounds = bounds.where(F.col("terms") == len(asked)).select("block", "bound", "n")

    def scored(chosen: DataFrame) -> DataFrame:
        each = own.join(chosen.select("block"), "block").select("term", "idf", F.explode("postings").alias("x")).select("term", "idf", "x.*")
        c = F.col("tf").cast("double")
        parts = [F.sum(F.when(F.col("term") == t, F.lit(idf[t]) * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("n") / F.lit(float(stats["mean"])))))) for t in asked]
        hits = each.groupBy("doc").agg(F.count("*").alias("terms"), reduce(lambda a, b: a + b, parts).alias("score"))
        return hits.where(F.col("terms") == len(asked)).select("doc", "score").orderBy(F.desc("score"), "doc").limit(k)

    best = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
    if not best:
        return nothing, None
    begun = scored(bounds.where(F.col("block").isin(best))).collect()
    least = begun[-1]["score"] if len(begun) == k else float("-inf")
    # a bound is a sum in another order than a score: a part in 10^9 is granted
    chosen = bounds.where(F.col("block").isin(best) | (F.col("bound") * (1 + 1e-9) >= least))
    return scored(chosen).join(index.rows, "doc").select("id", "score").orderBy(F.desc("score"), "id").limit(k), chosen
