"""Alignment of pages with the section tree: heading arbitration, carried headings, islands, corrected leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, leading_heading, strip
from .intervals import first_claim



def _by_page():
    return Window.partitionBy("document_id").orderBy("page_number")


def carried_headings(pages: DataFrame, heading: str = "heading") -> DataFrame:
    """pages with current: the last heading seen up to each page (heading is null where a page has none)."""
    return pages.withColumn("current", F.last(heading, ignorenulls=True).over(_by_page().rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def arbitrated(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """pages: document_id, page_number, text. For each page section, title, kept (the leaf, if the tree won) and warning."""
    claims = first_claim(pages, leaves)
    # headings are read before the join, so that no text is shuffled
    headed = pages.select("document_id", "page_number", leading_heading(F.col("text")).alias("heading"))
    x = carried_headings(headed.join(claims, ["document_id", "page_number"], "left"))
    sec = strip(F.coalesce(F.col("leaf.section_id"), F.lit("")))
    title = strip(F.coalesce(F.col("leaf.title"), F.lit("")))
    x = x.withColumns({"_sec": sec, "_title": title})
    seen, tree = F.col("heading").isNotNull(), F.col("_sec") != ""
    below = tree & ((F.col("_sec") == F.col("heading.section")) | F.col("_sec").startswith(F.concat(F.col("heading.section"), F.lit("."))))
    example = F.col("leaf").isNotNull() & F.lower("_title").startswith("example") & F.col("current").isNotNull()
    branch = F.when(seen & below, 1).when(seen, 2).when(tree, 3).when(example, 4).when(F.col("leaf").isNotNull(), 5).when(F.col("current").isNotNull(), 6).otherwise(7)
    x = x.withColumn("branch", branch)
    b = F.col("branch")
    p = F.concat(F.lit("p"), F.col("page_number").cast("string"), F.lit(": "))
    return x.select(
        "document_id",
        "page_number",
        "branch",
        F.when(b.isin(1, 3), F.col("_sec")).when(b == 2, F.col("heading.section")).when(b.isin(4, 6), F.col("current.section")).otherwise("").alias("section"),
        F.when(b.isin(1, 3, 5), F.col("_title")).when(b == 2, F.col("heading.title")).when(b.isin(4, 6), F.col("current.title")).otherwise("").alias("title"),
        F.when(b.isin(1, 3, 5), F.col("leaf")).alias("kept"),
        F.when((b == 2) & tree, F.concat(p, F.lit("vision heading '"), F.col("heading.title"), F.lit("' overrides tree leaf '"), F.col("_title"), F.lit("' (sec="), F.col("_sec"), F.lit(")")))
        .when(b == 4, F.concat(p, F.lit("absorbed '"), F.col("_title"), F.lit("' into current section '"), F.col("current.title"), F.lit("'")))
        .alias("warning"),
    )


def islands(pages: DataFrame, *keys: str) -> DataFrame:
    """pages with island: the number of the run of equal keys, in page order within a document."""
    changed = F.lit(False)
    for k in keys:
        changed = changed | ~F.col(k).eqNullSafe(F.lag(k).over(_by_page()))
    first = F.row_number().over(_by_page()) == 1
    return pages.withColumn("_new", (first | changed).cast("int")).withColumn("island", F.sum("_new").over(_by_page().rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def corrected_leaves(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Leaves after arbitration, one for each run of pages: document_id, leaf_pos, node_id, title, section_id, start_index,
    end_index, summary. Runs without section and leaf are left out."""
    runs = islands(arbitrated(pages, leaves), "section", "title")
    own = F.col("kept").isNotNull() & (strip(F.coalesce(F.col("kept.section_id"), F.lit(""))) == F.col("section"))
    x = runs.groupBy("document_id", "island", "section", "title").agg(F.min("page_number").alias("start_index"), F.max("page_number").alias("end_index"), F.min_by(F.when(own, F.col("kept")), F.when(own, F.col("page_number"))).alias("leaf"))
    x = x.where((F.col("section") != "") | F.col("leaf").isNotNull())
    old = F.coalesce(F.col("leaf.title"), F.lit(""))
    keeps = old.contains(F.col("section")) & (F.length(old) >= F.length("title"))
    synthetic = F.col("leaf").isNull()
    title = F.when(synthetic, first_filled(F.col("title"), F.col("section"))).when((F.col("section") == "") | keeps, F.col("leaf.title")).otherwise(F.col("title"))
    return x.select(
        "document_id",
        F.col("island").cast("int").alias("leaf_pos"),
        F.when(synthetic, F.concat(F.lit("VISION#"), F.col("section"))).otherwise(F.col("leaf.node_id")).alias("node_id"),
        title.alias("title"),
        F.when(synthetic, F.col("section")).otherwise(F.col("leaf.section_id")).alias("section_id"),
        "start_index",
        "end_index",
        F.when(synthetic, "").otherwise(F.coalesce(F.col("leaf.summary"), F.lit(""))).alias("summary"),
    )
