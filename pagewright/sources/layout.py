"""Layouts of the chunk table for access by parent and by section.

``by_family`` writes chunks in buckets of their family (a parent and its children), as a table under an explicit path: the join of children with their parent reads bucket against
bucket, without a shuffle. Parents have no parents of their own. A family is read by one task; it is as large as a parent has children. ``by_section`` writes them in ranges of document and section, sorted, so that
Parquet's statistics leave a lookup few row groups.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_family(chunks: DataFrame, path: str, buckets: int = 64) -> DataFrame:
    """Write chunks (id, parent_id and others) under path, in so many buckets; the table read back, with family. Its name in the session's catalogue is new for each call."""
    name = f"chunks_{uuid.uuid4().hex}"
    rows = chunks.withColumn("family", F.coalesce("parent_id", "id"))
    rows.repartition(buckets, "family").write.bucketBy(buckets, "family").sortBy("family").option("path", path).format("parquet").saveAsTable(name)
    return chunks.sparkSession.table(name)


def parents_of(table: DataFrame) -> DataFrame:
    """id and the struct parent of all chunks of by_family() that have one."""
    title = F.coalesce(F.nullif("title", F.lit("")), "topic", F.lit(""))
    parent = F.struct(F.col("id").alias("id"), title.alias("title"), F.coalesce("section_id", F.lit("")).alias("section_id"), "page_start", "page_end")
    parents = table.where("id = family").select("family", parent.alias("parent"))
    children = table.where("parent_id is not null").select("family", "id")
    return children.join(parents.hint("merge"), "family").select("id", "parent")


def by_section(chunks: DataFrame, path: str, group_bytes: int = 16 << 20, files: int | None = None) -> DataFrame:
    """Write chunks under path in ranges of (document_id, section_id), files of them (as the size asks for), in row groups of about group_bytes; read back."""
    keys = ["document_id", "section_id", "id"]
    ranges = (chunks.repartitionByRange(files, *keys) if files else chunks.repartitionByRange(*keys)).sortWithinPartitions("document_id", "section_id", "id")
    ranges.write.mode("overwrite").option("parquet.block.size", group_bytes).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)
