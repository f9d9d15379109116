"""The engine: documents are uploaded, ingested, get a section tree, are enriched to chunks and searched."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.backends import CallLimit, EmbeddingBackend, HashingBackend, SplitBackend, SummaryBackend, VisionBackend, extract_pages, no_split, no_summary
from ..functions.records import VISION, merged_page, page_flags, parse_vision, valid_formulas
from ..functions.text import QUERY_TYPES, query_type
from ..operators import keyword_index
from ..operators.chunks import chunk_keywords, enrich, warnings, with_embeddings
from ..operators.intervals import page_grid
from ..operators.retrieval import hybrid, parents_in_page_order
from ..sources.pdf import page_count
from ..sources.store import PAST_VISION, READY_FOR_TREE, SEARCHABLE, cache_key, cache_misses, is_pdf, render_pages
from ..sources.tables import Tables, filled_pages
from ..sources.trees import leaves as tree_leaves
from ..sources.trees import uploads

VERSION = "v2"


class NotFound(LookupError):
    """No such document."""


class NotReady(ValueError):
    """The document isn't in a state for this."""


@dataclass
class Engine:
    """Its tables are Parquet under root (see sources.tables), so another engine on the same folder goes on where this one was. vision reads a page
    image, decoder(content, zoom) yields the images of a PDF."""

    spark: SparkSession
    root: str | None = None
    embedding: EmbeddingBackend = field(default_factory=lambda: HashingBackend(256))
    summary: SummaryBackend = no_summary
    splitter: SplitBackend = no_split
    vision: VisionBackend | None = None
    decoder: object = None
    settings: Settings | None = None

    def __post_init__(self) -> None:
        self.settings = self.settings or Settings.of(self.spark)
        self.tables = Tables(self.spark, self.root or self.settings.root)

    def health(self) -> dict:
        return {"status": "ok"}

    def status(self, document_id: str) -> dict:
        found = self.tables.documents(document_id).select("status", "page_count", "filename").first()
        if found is None:
            raise NotFound(document_id)
        return {"document_id": document_id, **found.asDict()}

    def upload(self, path: str, filename: str | None = None) -> dict:
        """Take a PDF file, by a path that Spark reads. Its id is a hash of its name and content, so the same upload is the same document."""
        name = path.rstrip("/").rsplit("/", 1)[-1] if filename is None else filename
        if not self.spark.range(1).select(is_pdf(F.lit(name)).alias("ok")).first()["ok"]:
            raise ValueError("Only PDF files are supported")
        file = self.spark.read.format("binaryFile").load(path).select(F.sha2(F.concat(F.encode(F.lit(name), "utf-8"), F.unhex(F.lit("00")), "content"), 256).alias("document_id"), "content")
        document_id = file.select("document_id").first()["document_id"]
        if self.tables.documents(document_id).isEmpty():
            self.tables.append("uploads", file)
            pages = file.select(page_count(F.col("content")).alias("n")).first()["n"]
            self.tables.event(document_id, filename=name or "unknown.pdf", pdf_path=path, status="pending", **({} if pages is None else {"page_count": pages}))
        return {"document_id": document_id, "status": "ingestion_started"}

    def run(self, document_id: str) -> dict:
        """Render and read the pages of an upload: only pages whose content no cached record has go to the vision backend. A page that fails is left
        out of the cache and merged empty. If anything else fails, so does the document."""
        now = self.status(document_id)
        if now["status"] in PAST_VISION:
            return now
        images = None
        try:
            files = self.tables.rows("uploads", document_id).dropDuplicates(["document_id"]).select(F.col("document_id").alias("path"), "content")
            images = render_pages(files, self.decoder).withColumn("key", cache_key(F.col("content"))).persist()
            records = self.extracted(images)
            counts = images.groupBy("document_id").agg(F.max("page_number").alias("total_pages"))
            grid = page_grid(counts, records.where("false").select("document_id", "page_number"), records)
            vision = F.coalesce(F.col("v"), parse_vision(F.lit("{}")))
            empty = F.array().cast("array<string>")
            merged = grid.select("document_id", "page_number", vision.cast(VISION).alias("v")).select("document_id", "page_number", *merged_page(F.col("v"), F.lit(""), empty, F.lit("")))
            return self.ingest(document_id, merged)
        except Exception:
            self.tables.event(document_id, status="failed")
            raise
        finally:
            if images is not None:
                images.unpersist()

    def extracted(self, images: DataFrame) -> DataFrame:
        """images: document_id, page_number, content, key. document_id, page_number and the vision record v of the pages that have one; new ones are cached."""
        missing = cache_misses(images, self.tables.cache()).dropDuplicates(["key"])
        read = extract_pages(missing, self.vision, limit=CallLimit(self.settings.vision_concurrency, self.settings.model_attempts)).join(missing.select("document_id", "page_number", "key"), ["document_id", "page_number"])
        self.tables.save_cache(read)
        return images.select("document_id", "page_number", "key").join(self.tables.cache(), "key").select("document_id", "page_number", parse_vision(F.col("record")).alias("v"))

    def ingest(self, document_id: str, pages: DataFrame, filename: str | None = None) -> dict:
        """pages: document_id, page_number and fields of page records. Upserted by page; a document that is past ingestion is left as it is."""
        known = self.tables.documents(document_id).first()
        if known is not None and known["status"] in READY_FOR_TREE:
            return self.status(document_id)
        own = filled_pages(pages.where(F.col("document_id") == document_id).select("*", *[F.lit(None).alias(c) for c in _lacking(pages)]))
        own = own.select("*", *page_flags(F.col("text"), F.col("diagrams"), F.col("tables"), F.col("graphs"), F.col("formulas"))).withColumn("formulas", valid_formulas(F.col("formulas")))
        self.tables.save_pages(own)
        name = filename or (known["filename"] if known is not None else None) or "unknown.pdf"
        self.tables.event(document_id, status="vision_done", page_count=self.tables.pages(document_id).count(), filename=name)
        return self.status(document_id)

    def load_tree(self, document_id: str, tree: DataFrame | dict | str) -> int:
        """tree: an upload (JSON or what it stands for: tree, an object or a list, and flat_nodes), or leaves as rows: document_id, leaf_pos, node_id, title,
        section_id, start_index, end_index, summary. The number of leaves; the last tree counts."""
        now = self.status(document_id)["status"]
        if now not in READY_FOR_TREE:
            raise NotReady(now)
        if isinstance(tree, DataFrame):
            own = tree.where(F.col("document_id") == document_id)
            node = F.struct("node_id", "title", "section_id", "start_index", "end_index", "summary")
            nodes = own.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("leaf_pos", node.alias("n")))), lambda x: x["n"]).alias("nodes"))
            upload = nodes.select("document_id", F.to_json(F.struct(F.col("nodes").alias("nodes"))).alias("tree"), F.to_json("nodes").alias("flat_nodes"))
        else:
            body = tree if isinstance(tree, str) else json.dumps(tree)
            upload = uploads(self.spark.createDataFrame([(document_id, body)], "document_id string, body string"))
        rows = tree_leaves(upload)
        n = rows.count()
        if rows.where("start_index is null or end_index is null").count():
            raise ValueError("a leaf has no page range")
        self.tables.save_trees(upload)
        self.tables.event(document_id, status="tree_uploaded")
        return n

    def enrich(self, document_id: str, split: bool | None = None) -> dict:
        """Chunks of a document, in place of those that it had: numbers of parents, children and warnings."""
        self.status(document_id)
        pages = filled_pages(self.tables.pages(document_id))
        if pages.isEmpty():
            raise NotReady("no page records")
        trees = self.tables.trees(document_id)
        if trees.isEmpty():
            raise NotReady("no section tree")
        leaves = tree_leaves(trees)
        split = self.settings.enable_concept_split if split is None else split
        parents, children = enrich(pages, leaves, split=split, summary=self.summary, splitter=self.splitter, limit=CallLimit(self.settings.summary_concurrency, self.settings.model_attempts))
        both = parents.drop("leaf_pos", "offsets").unionByName(children, allowMissingColumns=True).withColumn("keywords", chunk_keywords())
        document = self.spark.createDataFrame([(document_id,)], "document_id string")
        n = self.tables.replace_chunks(with_embeddings(both, self.embedding), VERSION, document).first()
        stored = self.tables.chunks(document_id)
        told = warnings(pages, leaves, stored.where("is_parent"), stored.where("not is_parent")).count()
        parents.unpersist()
        return {"parents": n["parents"], "children": n["children"], "warnings": told}

    def _index_path(self, document_id: str) -> str:
        """Where the keyword index of a document's present chunks lies, if there is one."""
        now = self.tables.rows("documents", document_id).where("chunks is not null").agg(F.max("chunks")).first()[0]
        return f"keyword/{hashlib.sha256(document_id.encode()).hexdigest()}/{now}"

    def index(self, document_id: str) -> int:
        """Write the keyword index of a document's chunks, which searches read until the chunks are replaced; the number of its rows. Worth its while for large documents."""
        if self.status(document_id)["status"] not in SEARCHABLE:
            raise NotReady("no chunks")
        chunks = self.tables.chunks(document_id).select("id", "search_text")
        return keyword_index.build(chunks).write(f"{self.tables.root}/{self._index_path(document_id)}").rows.count()

    def _keyword(self, document_id: str, query: str, top_k: int) -> DataFrame | None:
        path = self._index_path(document_id)
        store, where = self.tables._path(f"{path}/words/_SUCCESS")  # what is written last
        if not store.exists(where):
            return None
        return keyword_index.search(keyword_index.read(self.spark, f"{self.tables.root}/{path}"), query, top_k)

    def search(self, document_id: str, query: str, top_k: int | None = None, kind: str | None = None) -> DataFrame:
        """The chunks found, in order. An explicit kind wins over the classifier; comprehensive gives all parents."""
        now = self.status(document_id)["status"]
        if now not in SEARCHABLE:
            raise NotReady(now)
        top_k = self.settings.default_top_k if top_k is None else top_k
        if top_k < 1 or kind is not None and kind not in QUERY_TYPES:
            raise ValueError("top_k or query type")
        kind = kind or self.spark.range(1).select(query_type(F.lit(query)).alias("t")).first()["t"]
        chunks = self.tables.chunks(document_id)
        if kind == "comprehensive":
            return parents_in_page_order(chunks)
        vector = self.embedding.embed([query])[0].tolist()
        found = hybrid(chunks, query, vector, top_k, kind, self.settings.rrf_k, self._keyword(document_id, query, top_k))
        return found.join(chunks.drop("search_embedding", "formula_embedding", "table_embedding"), "id").orderBy(F.desc("rrf"), "first_seen", "id")


def _lacking(pages: DataFrame) -> list[str]:
    from ..functions.records import PAGE_FIELDS

    return [c for c in PAGE_FIELDS if c not in pages.columns]
