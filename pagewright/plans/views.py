"""Views over the driver's tables that stand for pages, section trees, headings and chunks, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of a source that are numbered together, so that texts are dealt evenly however few sources there are.
IDS = 4096


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each row of documents; the source is the document. Rows are counted by source and range of ids, and numbered within."""
    # a struct, whose nulls are equal
    d = table(spark, sf_dir, "documents").withColumn("_key", F.struct("source", F.floor(F.col("doc_id") / IDS).alias("ids")))
    before = Window.partitionBy("_key.source").orderBy("_key.ids").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy("_key").agg(F.count("*").alias("_n")).select("_key", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id"))
    numbered = d.withColumn("_own", own).join(counts, "_key")
    return numbered.select(F.col("source").alias("document_id"), (F.col("_before") + F.col("_own")).cast("int").alias("page_number"), "doc_id", "lang", "text")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf for every five pages; each fifth leaf runs on over the next one."""
    p = pages(spark, sf_dir).select("document_id", F.floor((F.col("page_number") - 1) / 5).cast("int").alias("leaf_pos"), "page_number")
    g = p.groupBy("document_id", "leaf_pos").agg(F.min("page_number").alias("start_index"))
    pos = F.col("leaf_pos").cast("string")
    return g.select(
        "document_id",
        "leaf_pos",
        F.concat(F.lit("n"), pos).alias("node_id"),
        F.concat((1 + F.col("leaf_pos") % 9).cast("string"), F.lit("."), pos).alias("section_id"),
        F.when(F.col("leaf_pos") % 4 == 3, F.concat(F.lit("Example "), pos)).otherwise(F.concat(F.lit("Section "), pos)).alias("title"),
        "start_index",
        F.when(F.col("leaf_pos") % 5 == 4, F.col("start_index") + 7).otherwise(F.col("start_index") + 3).alias("end_index"),
        F.concat(F.lit("summary "), pos).alias("summary"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A two-level forest: pages 1, 6, 11, ... are parents of the four that follow."""
    # numbers, parents and vectors are found for the ids alone; the texts are joined last, and shuffled once
    ids = pages(spark, sf_dir).select("document_id", "page_number", "doc_id")
    first = F.col("page_number") % 5 == 1
    begins = ids.where(first).select(F.struct("document_id", "page_number").alias("_first"), F.col("doc_id").alias("_parent"))
    at = F.struct("document_id", (F.col("page_number") - (F.col("page_number") - 1) % 5).alias("page_number"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("search_embedding"))
    placed = ids.withColumn("_first", at).join(begins, "_first").withColumn("_key", F.struct("document_id", "doc_id"))
    # rows of a source may repeat an id: their pages are dealt to them in turn
    placed = placed.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("page_number", "_parent"))).alias("_pages"))
    placed = placed.withColumn("doc_id", F.col("_key.doc_id")).join(e, "doc_id", "left").drop("doc_id")
    d = table(spark, sf_dir, "documents").select(F.struct(F.col("source").alias("document_id"), "doc_id").alias("_key"), F.col("source").alias("document_id"), "doc_id", "lang", "text")
    turn = F.row_number().over(Window.partitionBy("_key").orderBy("doc_id"))
    p = d.withColumn("_turn", turn).join(placed, "_key").withColumn("_page", F.get("_pages", F.col("_turn") - 1)).select("*", "_page.*")
    section = F.concat((1 + F.col("page_number") % 9).cast("string"), F.lit("."), F.col("page_number").cast("string"))
    return p.select(
        F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("id"),
        "document_id",
        F.col("page_number").alias("page_start"),
        F.col("page_number").alias("page_end"),
        first.alias("is_parent"),
        F.when(~first, F.concat(F.lit("c"), F.col("_parent").cast("string"))).alias("parent_id"),
        F.concat(F.lit("n"), F.col("page_number").cast("string")).alias("node_id"),
        section.alias("section_id"),
        F.left("text", F.lit(60)).alias("title"),
        F.concat(section, F.lit(" "), F.left("text", F.lit(30))).alias("topic"),
        F.col("text").alias("search_text"),
        "search_embedding",
        F.when(F.col("doc_id") % 2 == 0, F.col("search_embedding")).alias("formula_embedding"),
        F.when(F.col("lang") == "en", F.col("search_embedding")).alias("table_embedding"),
    )


PAGES = "pages_v AS (SELECT source AS document_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS int) AS page_number, doc_id, lang, text FROM documents)"
TREE = """tree_v AS (SELECT document_id, leaf_pos, concat('n', leaf_pos) AS node_id, concat(1 + leaf_pos % 9, '.', leaf_pos) AS section_id,
  CASE WHEN leaf_pos % 4 = 3 THEN concat('Example ', leaf_pos) ELSE concat('Section ', leaf_pos) END AS title, start_index,
  CASE WHEN leaf_pos % 5 = 4 THEN start_index + 7 ELSE start_index + 3 END AS end_index, concat('summary ', leaf_pos) AS summary
  FROM (SELECT document_id, CAST(floor((page_number - 1) / 5.0) AS int) AS leaf_pos, min(page_number) AS start_index FROM pages_v GROUP BY 1, 2))"""
CHUNKS = """chunks_v AS (SELECT concat('c', p.doc_id) AS id, p.document_id, p.page_number AS page_start, p.page_number AS page_end, p.page_number % 5 = 1 AS is_parent,
  CASE WHEN p.page_number % 5 <> 1 THEN concat('c', f.doc_id) END AS parent_id, concat('n', p.page_number) AS node_id,
  concat(1 + p.page_number % 9, '.', p.page_number) AS section_id, left(p.text, 60) AS title,
  concat(1 + p.page_number % 9, '.', p.page_number, ' ', left(p.text, 30)) AS topic, p.text AS search_text, e.embedding AS search_embedding,
  CASE WHEN p.doc_id % 2 = 0 THEN e.embedding END AS formula_embedding, CASE WHEN p.lang = 'en' THEN e.embedding END AS table_embedding
  FROM pages_v p LEFT JOIN embeddings e ON e.vec_id = p.doc_id
  LEFT JOIN pages_v f ON f.document_id = p.document_id AND f.page_number = p.page_number - (p.page_number - 1) % 5)"""


def with_views(*views: str, body: str) -> str:
    return "WITH " + ",\n".join(views) + "\n" + body
