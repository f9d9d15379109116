"""The jobs as registered queries, and the same in DuckDB's dialect. Each call works in a new folder, which stays."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.store import shared_folder

from . import build_keyword_index, ingest_pages


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_keyword_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents, built twice into one folder: headers of its blocks."""
    folder = _folder(spark, "job1")
    build_keyword_index.run(spark, f"{sf_dir}/documents.parquet", folder, {"width": 128})
    return build_keyword_index.run(spark, f"{sf_dir}/documents.parquet", folder, {"width": 128})


def job2_ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken into one folder by two runs with one checkpoint; the second finds nothing new."""
    folder = _folder(spark, "job2")
    for _ in range(2):
        pages = ingest_pages.run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/out", f"{folder}/checkpoint")
    return pages


QUERIES = {"job1_keyword_index": job1_keyword_index, "job2_ingest_pages": job2_ingest_pages}

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
ORACLES = {
    "job1_keyword_index": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc, len(w) AS n, avg(len(w)) OVER () AS mean FROM d),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
p AS (SELECT term, doc, doc // 128 AS block, tf, tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean)) AS weight FROM t JOIN r USING (doc_id)),
b AS (SELECT term, block, count(*) AS n_docs, sum(tf)::BIGINT AS n_words, round(max(weight), 6) AS peak, min(doc) AS first_doc, max(doc) AS last_doc FROM p GROUP BY term, block)
SELECT term, block, n_docs, n_words, peak, first_doc, last_doc, CAST(sum(n_docs) OVER (PARTITION BY term) AS BIGINT) AS df FROM b""",
    "job2_ingest_pages": rf"""
WITH c AS (SELECT doc_id, source AS document_id, lang, coalesce(regexp_replace(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '') AS text FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, document_id, lang, sha256('v3'::BLOB || '\x00'::BLOB || encode(text)) AS digest, len({_WORDS})::INT AS n_words, len(list_distinct(regexp_extract_all(text, '\b(\d+(?:\.\d+){{1,3}})\b', 1)))::INT AS n_sections,
  length(regexp_replace(text, '^\s+|\s+$', '', 'g')) < 50 AS low_prose FROM c)
SELECT *, count(*) OVER d AS pages, CAST(sum(n_words) OVER d AS BIGINT) AS words, count(*) FILTER (low_prose) OVER d AS low_prose_pages FROM p WINDOW d AS (PARTITION BY document_id)""",
}
