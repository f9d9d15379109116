"""An inverted index of letter trigrams, and the rows that are similar to a table of queries by it.

Postings lie sorted by trigram. A row with a similarity of t to a query of n trigrams has at least t * n of them, so it has one of the query's n - ceil(t * n) + 1
rarest: only their postings are read (prefix filter), and of those only rows whose size lets them reach t. How often a candidate was met
among them, with all the others granted, must reach the overlap that t asks for; who passes is compared trigram by trigram. Nothing is lost and no pair
is guessed. Rows without id or trigrams are similar to nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trigrams


@dataclass(frozen=True)
class TrigramIndex:
    """postings: gram, id, size; sets: id, grams; counts: gram, df."""

    postings: DataFrame
    sets: DataFrame
    counts: DataFrame


def build(rows: DataFrame, path: str, text: str = "text") -> TrigramIndex:
    """Write the index of rows (id and text) under path and read it back. Ids are distinct."""
    sets = rows.where("id is not null").select("id", trigrams(F.col(text)).alias("grams")).where(F.size("grams") > 0)
    sets.write.mode("overwrite").parquet(f"{path}/sets")
    spark = rows.sparkSession
    sets = spark.read.parquet(f"{path}/sets")
    postings = sets.select(F.explode("grams").alias("gram"), "id", F.size("grams").alias("size"))
    postings.repartitionByRange("gram", "size", "id").sortWithinPartitions("gram", "size", "id").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("gram").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{path}/counts")
    return read(spark, path)


def read(spark: SparkSession, path: str) -> TrigramIndex:
    return TrigramIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "sets", "counts")))


def similar(index: TrigramIndex, queries: DataFrame, least: float, text: str = "text", max_broadcast: int = 1_000_000) -> DataFrame:
    """qid, id, similarity of all pairs of a query (qid and text) and a row with a similarity of least or more (above 0). The trigrams of the queries are broadcast up to
    max_broadcast of them, counted first; more are joined by shuffle."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    asked = queries.where("qid is not null").select("qid", trigrams(F.col(text)).alias("q")).where(F.size("q") > 0)
    few = (asked.agg(F.sum(F.size("q"))).first()[0] or 0) <= max_broadcast
    each = asked.select("qid", F.size("q").alias("n"), F.explode("q").alias("gram"))
    rare = index.counts.join(F.broadcast(each) if few else each, "gram", "right").select("qid", "n", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram").alias("g"))
    ordered = rare.groupBy("qid", "n").agg(F.sort_array(F.collect_list("g")).alias("g"))
    tiny = 1e-9  # a product such as 0.3 * 10 may lie above the whole number
    need = F.ceil(F.col("n") * least - tiny)
    prefix = ordered.select("qid", "n", F.explode(F.slice("g", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("g"), (need - 1).alias("granted")).select("qid", "n", "granted", "g.gram")
    met = index.postings.join(F.broadcast(prefix) if few else prefix, "gram").where((F.col("size") >= F.col("n") * least - tiny) & (F.col("size") * least <= F.col("n") + tiny))
    counted = met.groupBy("qid", "id").agg(F.count("*").alias("met"), F.first("granted").alias("granted"), F.first(F.col("n") + F.col("size")).alias("both"))
    overlap = F.col("both") * (least / (1 + least)) - tiny  # that two sets with this similarity share
    candidates = counted.where(F.col("met") + F.col("granted") >= overlap).select("qid", "id")
    pairs = candidates.join(index.sets, "id").join(F.broadcast(asked) if few else asked, "qid")
    shared = F.size(F.array_intersect("grams", "q")).cast("double")
    scored = pairs.select("qid", "id", (shared / (F.size("grams") + F.size("q") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= least)
