"""Interval operators on page ranges: covering nodes, first claims, grids, de-overlap, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Widths of the blocks of pages in which ranges and pages meet: a range goes to the narrowest of which it needs 65 at most.
WIDTHS = tuple(16 * 64**k for k in range(5))


def spread(leaves: DataFrame) -> DataFrame:
    """leaves with _width and _block: a row for each block that the range touches, 65 at most however long it is. Rows with a null bound hold no page."""
    n = F.col("end_index").cast("long") - F.col("start_index") + 1
    width = F.lit(WIDTHS[-1])
    for w in reversed(WIDTHS[:-1]):
        width = F.when(n <= 64 * w, F.lit(w)).otherwise(width)
    placed = leaves.where("start_index <= end_index").withColumn("_width", width)
    return placed.withColumn("_block", F.explode(F.sequence(F.floor(F.col("start_index") / F.col("_width")), F.floor(F.col("end_index") / F.col("_width")))))


def _met(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """document_id and page_number of pages with the leaves whose range holds them, as an equi-join on blocks."""
    keys = pages.select("document_id", "page_number").withColumn("_width", F.explode(F.array(*[F.lit(w) for w in WIDTHS])))
    near = keys.withColumn("_block", F.floor(F.col("page_number") / F.col("_width"))).join(spread(leaves), ["document_id", "_width", "_block"])
    return near.where("page_number between start_index and end_index").drop("_block", "_width")


def covering(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Pairs of a page and a leaf whose range holds it. pages: document_id, page_number and others; leaves: document_id, start_index, end_index. Pages are met by their numbers alone; what
    else they have is joined to the pairs."""
    return pages.join(_met(pages.select("document_id", "page_number").distinct(), leaves), ["document_id", "page_number"])


def narrowest_cover(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """document_id, page_number, summary of the shortest leaf that holds the page (the first listed on ties), else ''."""
    span = F.struct((F.col("end_index") - F.col("start_index")).alias("n"), "leaf_pos")
    own = _met(pages, leaves).groupBy("document_id", "page_number").agg(F.min_by(F.coalesce("summary", F.lit("")), span).alias("summary"))
    return pages.select("document_id", "page_number").join(own, ["document_id", "page_number"], "left").withColumn("summary", F.coalesce("summary", F.lit("")))


def first_claim(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """document_id, page_number and the struct leaf that is first in list order among those that hold the page."""
    leaf = F.struct("leaf_pos", "node_id", "title", "section_id", "start_index", "end_index", "summary")
    return _met(pages, leaves).groupBy("document_id", "page_number").agg(F.min_by(leaf, "leaf_pos").alias("leaf"))


def deoverlap(leaves: DataFrame) -> DataFrame:
    """Disjoint ranges, greedily by start and then by length: new_start, new_end; an emptied range ends before its start."""
    order = Window.partitionBy("document_id").orderBy(F.col("start_index"), F.col("end_index").desc(), F.col("leaf_pos"))
    ended = F.coalesce(F.max("end_index").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    moved = F.greatest(F.col("start_index"), ended + 1)
    empty = moved > F.col("end_index")
    return leaves.withColumns({"new_start": F.when(empty, F.col("start_index")).otherwise(moved), "new_end": F.when(empty, F.col("start_index") - 1).otherwise(F.col("end_index"))})


def orphan_pages(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """Pages that no leaf holds."""
    held = _met(pages, leaves).select("document_id", "page_number").distinct()
    return pages.join(held, ["document_id", "page_number"], "left_anti")


def orphan_sweep(pages: DataFrame, leaves: DataFrame) -> DataFrame:
    """One leaf for each document with orphan pages: UNMAPPED_PAGES from the first to the last of them."""
    return orphan_pages(pages, leaves).groupBy("document_id").agg(F.lit("UNMAPPED_PAGES").alias("node_id"), F.min("page_number").alias("start_index"), F.max("page_number").alias("end_index"), F.count("*").alias("n_pages"))


def page_grid(counts: DataFrame, tree_pages: DataFrame, vision_pages: DataFrame) -> DataFrame:
    """Every page 1..total of each document with what the two sources have of it. counts: document_id, total_pages."""
    grid = counts.where("total_pages > 0").select("document_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_number"))
    return grid.join(tree_pages, ["document_id", "page_number"], "left").join(vision_pages, ["document_id", "page_number"], "left")
