"""The engine's tables on Parquet. They are append-only: every write is a batch in a folder of its own, so nothing is rewritten in place, a
lost executor or a failed job leaves no half of a batch, and writers don't disturb each other. Readers take the last of what they ask for:

* documents: status events; a field's value is that of the last event that has one.
* pages: the last record of a page. trees: the last tree of a document.
* chunks: the batch that the last event of a (document, version) names: writing the event is what commits them, so a search
  sees either all old chunks of a document or all new ones.
* cache: vision records by content key.

Rows lie in ``parts`` folders by a hash of their document (or key), so what is asked about one document reads one of them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.records import FORMULA, PAGE, PAGE_FIELDS, RICH, TABLE

EVENT_FIELDS = {"filename": "string", "pdf_path": "string", "page_count": "int", "status": "string", "pipeline_version": "string", "chunks": "string"}
CHUNK_FIELDS = {
    "id": "string", "node_id": "string", "topic": "string", "topic_scope": "string", "related_topics": "array<string>", "exclude_keywords": "array<string>", "page_start": "int", "page_end": "int",
    "search_text": "string", "formulas": f"array<{FORMULA}>", "tables": f"array<{TABLE}>", "pages_data": f"array<{PAGE}>", "keywords": "array<string>", "section_id": "string", "rich_summary": RICH,
    "parent_id": "string", "is_parent": "boolean", "title": "string", "content": "string", "pipeline_version": "string", "role": "string",
    "search_embedding": "array<float>", "formula_embedding": "array<float>", "table_embedding": "array<float>",
}
SCHEMAS = {
    "documents": {"document_id": "string", **EVENT_FIELDS, "at": "timestamp"},
    "uploads": {"document_id": "string", "content": "binary"},
    "trees": {"document_id": "string", "tree": "string", "flat_nodes": "string", "at": "timestamp"},
    "pages": {"document_id": "string", "page_number": "int", **PAGE_FIELDS, "low_prose": "boolean", "figure_only": "boolean", "bad_formula_count": "int"},
    "chunks": {"document_id": "string", **CHUNK_FIELDS},
    "cache": {"key": "string", "record": "string"},
}
KEYS = {name: next(iter(columns)) for name, columns in SCHEMAS.items()}


def shaped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """df with exactly these columns; those that it hasn't are null."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


class Tables:
    def __init__(self, spark: SparkSession, root: str, parts: int = 64):
        if not root:
            raise ValueError("the tables need a folder: spark.pagewright.root, PAGEWRIGHT_ROOT or root")
        self.spark, self.root, self.parts = spark, root.rstrip("/"), parts
        self._last = 0

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _batch(self) -> str:
        self._last = max(self._last + 1, time.time_ns())
        return f"{self._last:020d}-{uuid.uuid4().hex[:8]}"

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def append(self, name: str, df: DataFrame) -> str:
        """Write df as a batch; its name."""
        batch = self._batch()
        rows = shaped(df, SCHEMAS[name]).withColumn("part", self._part(F.col(KEYS[name])))
        rows.write.partitionBy("part").parquet(f"{self.root}/{name}/batch={batch}")
        return batch

    def rows(self, name: str, key: str | None = None) -> DataFrame:
        """All rows of all batches, with batch; of one document (or key) only, if asked."""
        store, path = self._path(name)
        schema = ", ".join(f"{c} {t}" for c, t in {**SCHEMAS[name], "batch": "string", "part": "int"}.items())
        if not store.exists(path):
            return self.spark.createDataFrame([], schema).drop("part")
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        if key is not None:
            df = df.where((F.col("part") == self._part(F.lit(key))) & (F.col(KEYS[name]) == key))
        return df.drop("part")

    # --- documents -----------------------------------------------------------------------------------------------------

    def record_events(self, events: DataFrame) -> str:
        """events: document_id, at and some of EVENT_FIELDS."""
        return self.append("documents", events)

    def event(self, document_id: str, **fields) -> str:
        columns = [F.lit(document_id).alias("document_id"), F.current_timestamp().alias("at"), *[F.lit(v).alias(k) for k, v in fields.items()]]
        return self.record_events(self.spark.range(1).select(*columns))

    def documents(self, key: str | None = None) -> DataFrame:
        """One row for each document: each field as the last event that has it says, created_at, updated_at, vision_done_at, enriched_at."""
        e = self.rows("documents", key)
        last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("at", "batch", c))).alias(c)
        when = lambda s: F.max(F.when(F.col("status") == s, F.col("at")))
        times = [F.min("at").alias("created_at"), F.max("at").alias("updated_at"), when("vision_done").alias("vision_done_at"), when("complete").alias("enriched_at")]
        return e.groupBy("document_id").agg(*[last(c) for c in EVENT_FIELDS], *times)

    # --- pages ----------------------------------------------------------------------------------------------------------

    def save_pages(self, pages: DataFrame) -> str:
        """Upsert page records; of records of one page in a batch the one with the most text counts, then the first by its text."""
        order = Window.partitionBy("document_id", "page_number").orderBy(F.desc(F.length(F.coalesce("text", F.lit("")))), "text", F.xxhash64(*[c for c in pages.columns if c not in ("document_id", "page_number")]))
        return self.append("pages", pages.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n"))

    def pages(self, key: str | None = None) -> DataFrame:
        rows = self.rows("pages", key)
        last = Window.partitionBy("document_id", "page_number").orderBy(F.desc("batch"))
        return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "batch")

    def load_pages(self, key: str) -> DataFrame:
        """The records of a document by page; what is null is an empty list or text."""
        return filled_pages(self.pages(key)).drop("document_id").orderBy("page_number")

    # --- trees ----------------------------------------------------------------------------------------------------------

    def save_trees(self, trees: DataFrame) -> str:
        return self.append("trees", trees.withColumn("at", F.current_timestamp()))

    def trees(self, key: str | None = None) -> DataFrame:
        """The last tree of each document: document_id, tree, flat_nodes."""
        one = F.max_by(F.struct("tree", "flat_nodes"), F.struct("batch", "flat_nodes", "tree")).alias("t")
        return self.rows("trees", key).groupBy("document_id").agg(one).select("document_id", "t.tree", "t.flat_nodes")

    # --- chunks ---------------------------------------------------------------------------------------------------------

    def replace_chunks(self, chunks: DataFrame, version: str, documents: DataFrame | None = None, status: str = "complete") -> DataFrame:
        """Write the chunks of documents, which replace those that they had in this version; document_id, parents, children that were written. documents
        (document_id) names those that may have none now."""
        rows = shaped(chunks, SCHEMAS["chunks"]).withColumn("pipeline_version", F.lit(version))
        text = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
        rows = rows.withColumns({"topic": text("topic", "title"), "search_text": text("search_text", "content"), "role": F.when(~F.col("is_parent"), F.col("role"))})
        batch = self.append("chunks", rows)
        written = self.rows("chunks").where(F.col("batch") == batch)
        counts = written.groupBy("document_id").agg(F.count_if("is_parent").alias("parents"), F.count_if(~F.col("is_parent")).alias("children"))
        if documents is not None:
            counts = documents.select("document_id").distinct().join(counts, "document_id", "left").na.fill(0, ["parents", "children"])
        self.record_events(counts.select("document_id", F.current_timestamp().alias("at"), F.lit(status).alias("status"), F.lit(version).alias("pipeline_version"), F.lit(batch).alias("chunks")))
        return counts

    def chunks(self, key: str | None = None) -> DataFrame:
        """The committed chunks of each document and version."""
        events = self.rows("documents", key).where("chunks is not null")
        now = events.groupBy("document_id", "pipeline_version").agg(F.max("chunks").alias("batch"))
        return self.rows("chunks", key).join(now, ["document_id", "pipeline_version", "batch"], "left_semi").drop("batch")

    # --- vision cache -----------------------------------------------------------------------------------------------------

    def cache(self) -> DataFrame:
        """key, record: one for each key (the first written)."""
        return self.rows("cache").groupBy("key").agg(F.min_by("record", F.struct("batch", "record")).alias("record"))

    def save_cache(self, records: DataFrame) -> str:
        """records: key, record; null records (failed pages) aren't kept."""
        return self.append("cache", records.where("record is not null").groupBy("key").agg(F.min("record").alias("record")))

    # --- upkeep -----------------------------------------------------------------------------------------------------------

    def compact(self, name: str) -> None:
        """Put what readers see into one batch. No writer may run meanwhile. Batches of pages, trees, cache, uploads and status events that it stands for are deleted, so no reader of these
        may run either; after a failure half-way rows are there twice, which readers don't notice. Replaced chunks stay until vacuum(), so their readers go on."""
        if name == "chunks":
            self._compact_chunks()
            return
        current = {"pages": self.pages, "trees": self.trees, "cache": self.cache, "documents": lambda: self.rows("documents").drop("batch"), "uploads": lambda: self.rows("uploads").drop("batch").dropDuplicates(["document_id"])}[name]()
        store, path = self._path(name)
        old = [f.getPath() for f in store.listStatus(path)] if store.exists(path) else []
        self.append(name, current)
        for p in old:
            store.delete(p, True)

    def _compact_chunks(self) -> None:
        """All committed chunks as one batch, which events then name."""
        batch = self.append("chunks", self.chunks())
        held = self.rows("chunks").where(F.col("batch") == batch).select("document_id", "pipeline_version").distinct()
        # the event is as old as the document's last one: nothing that is told of the document changes
        last = self.rows("documents").groupBy("document_id").agg(F.max("at").alias("at"))
        self.record_events(held.join(last, "document_id").select("document_id", "at", "pipeline_version", F.lit(batch).alias("chunks")))

    def vacuum(self, keep_seconds: float = 86_400) -> list[str]:
        """Delete the batches of chunks that no document's event names any more and that are older than keep_seconds, the time that a reader may still need them and a writer has to name
        what it wrote; their names."""
        events = self.rows("documents").where("chunks is not null")
        named = events.groupBy("document_id", "pipeline_version").agg(F.max("chunks").alias("batch")).select("batch").distinct()
        # batches named once, and since then no more, are as old as the event that replaced them
        replaced = events.groupBy("document_id", "pipeline_version").agg(F.max("chunks").alias("now"), F.collect_set("chunks").alias("all")).select("now", F.explode("all").alias("batch")).where("batch < now")
        until = f"{time.time_ns() - int(keep_seconds * 1e9):020d}"
        recent = replaced.where(F.col("now") >= until).select("batch")
        stored = self.rows("chunks").select("batch").distinct().where(F.col("batch") < until)
        gone = [r["batch"] for r in stored.join(named, "batch", "left_anti").join(recent, "batch", "left_anti").collect()]  # a name for each batch
        for batch in gone:
            store, path = self._path(f"chunks/batch={batch}")
            store.delete(path, True)
        return gone


def filled_pages(pages: DataFrame) -> DataFrame:
    """Page records with empty lists and texts in place of nulls."""
    empty = lambda t: F.lit("") if t == "string" else F.array().cast(t)
    return pages.select("document_id", "page_number", *[F.coalesce(F.col(c), empty(t)).alias(c) for c, t in PAGE_FIELDS.items()])


def json_cells(df: DataFrame) -> DataFrame:
    """df with its nested columns, but for lists of numbers and of texts, as JSON texts: for exports to tables of flat cells."""
    flat = lambda t: t.typeName() not in ("struct", "array", "map") or t.typeName() == "array" and t.elementType.typeName() not in ("struct", "array", "map")
    return df.select(*[F.col(f.name) if flat(f.dataType) else F.coalesce(F.to_json(f.name), F.lit("[]" if f.dataType.typeName() == "array" else "{}")).alias(f.name) for f in df.schema.fields])
