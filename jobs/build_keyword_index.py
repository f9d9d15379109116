"""Batch job: the keyword index that searches over a corpus read, built anew from its pages.

Reads documents (doc_id, text), cleans the texts' white space, and writes under the output folder: blocks/bucket=<n> (postings with block maxima),
words (document frequencies), rows (numbers and lengths) and stats. A rerun replaces them with the same rows. Searches: pagewright.operators.keyword_index.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main
from pagewright.functions.text import squeeze_newlines, squeeze_spaces
from pagewright.operators import keyword_index

LOG = logging.getLogger("build_keyword_index")
KNOWN = {"width": 4096, "buckets": 16}


def run(spark: SparkSession, documents: str, output: str, config: dict = KNOWN) -> DataFrame:
    """Build the keyword index of documents under output. Returns the headers of its blocks: term, block, n_docs, n_words, peak, first_doc, last_doc, df."""
    config = KNOWN | config
    LOG.info("reading %s, settings %s", documents, config)
    chunks = spark.read.parquet(documents).select(F.col("doc_id").alias("id"), squeeze_spaces(squeeze_newlines(F.col("text"))).alias("search_text"))
    index = keyword_index.build(chunks, width=config["width"], buckets=config["buckets"]).write(output)
    stats = index.stats.first()
    size = index.blocks.agg(F.count("*").alias("blocks"), F.sum("n_docs").alias("postings")).first()
    LOG.info("read %d documents of %.1f words on average", stats["n_docs"], stats["mean"])
    LOG.info("wrote %d blocks with %d postings of %d words to %s", size["blocks"], size["postings"] or 0, index.words.count(), output)
    return headers(index)


def headers(index: keyword_index.KeywordIndex) -> DataFrame:
    ends = [F.get("postings", F.lit(0))["doc"].alias("first_doc"), F.get("postings", F.size("postings") - 1)["doc"].alias("last_doc")]
    own = index.blocks.select("term", "block", "n_docs", "n_words", F.round("peak", 6).alias("peak"), *ends)
    return own.join(index.words.select("term", "df"), "term")


if __name__ == "__main__":
    main("build_keyword_index", run, {"documents": "Parquet with doc_id and text", "output": "folder of the index"}, KNOWN)
