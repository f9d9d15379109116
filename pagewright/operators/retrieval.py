"""Retrieval lanes (section, semantic, keyword), their fusion, and the parent rules of the fused list."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_tokens, section_numbers, terms
from ..sources import store

LANES = ("section", "semantic", "keyword", "formula", "table")
VECTOR_COLUMNS = ("search_embedding", "formula_embedding", "table_embedding")
K1, B = 1.2, 0.75


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in doubles; null if a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def semantic_lane(chunks: DataFrame, vector: list[float], k: int, column: str = "search_embedding") -> DataFrame:
    """id and score of the k rows nearest to vector, exactly; rows without vector or with a zero vector are not candidates."""
    if column not in VECTOR_COLUMNS:
        raise ValueError(f"unknown vector column {column!r}")
    q = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.where(F.col(column).isNotNull()).select("id", cosine(F.col(column), q).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def semantic_per_query(chunks: DataFrame, queries: DataFrame, k: int, block: int = 512, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """qid, id, score, rank: the k nearest rows of each query, exactly. The query vectors are broadcast, at most broadcast_bytes of them at once: more
    take another pass over the rows. Each task multiplies matrices, block queries at a time, and keeps k rows for each query; the rest is a top-k over
    what the tasks kept. No vector is shuffled."""
    spark = chunks.sparkSession
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, -(-size["n"] * 8 * max(1, size["d"] or 1) // broadcast_bytes))
    rows = chunks.where("embedding is not null").select("id", "embedding")

    def asked(number: int):
        own = queries.where("embedding is not null and qid is not null").where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == number).select("qid", "embedding").toArrow()
        q = np.array(own.column("embedding").to_pylist(), np.float64).reshape(own.num_rows, -1)
        long = np.linalg.norm(q, axis=1)
        return spark.sparkContext.broadcast((own.column("qid").to_numpy()[long > 0], q[long > 0] / long[long > 0][:, None]))

    def nearest(held):
        def run(frames):
            qids, vectors = held.value
            kept = Best(k)
            for frame in frames:
                m = np.array(frame["embedding"].tolist(), np.float64).reshape(len(frame), -1)
                norm = np.linalg.norm(m, axis=1)
                ids, m = frame["id"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0][:, None]
                for low in range(0, len(qids) if len(ids) else 0, block):
                    kept.add(qids[low : low + block], ids, vectors[low : low + block] @ m.T)
            yield from kept.frames()

        return run

    def one(number: int) -> DataFrame:
        held = asked(number)
        found = rows.mapInPandas(nearest(held), "qid long, id long, score double")
        if passes == 1:
            return found
        found = store.written(found, "nearest")  # so that no two passes hold their vectors at once
        held.destroy()
        return found

    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return reduce(DataFrame.unionByName, [one(n) for n in range(passes)]).withColumn("rank", rank).where(F.col("rank") <= k)


class Best:
    """The k best rows of each query that a task has met; ties go to the least ids."""

    def __init__(self, k: int, most: int = 1_000_000):
        self.k, self.most, self.waiting = k, most, 0
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, qids: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """score: a row for each of qids, a column for each of ids; -inf where they don't meet."""
        score = np.round(score, 9)
        # all ties with the k-th stay, so that ids decide
        least = np.partition(score, -self.k, axis=1)[:, -self.k] if len(ids) > self.k else np.full(len(score), -np.inf)
        n, at = np.nonzero((score >= least[:, None]) & (score > -np.inf))  # -inf: no match
        self.kept.append((qids[n], ids[at], score[n, at]))
        self.waiting += len(at)
        if self.waiting > self.most:
            self.kept = [self._best()]
            self.waiting = len(self.kept[0][0])

    def _best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, i, s = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        head = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        rank = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
        return q[rank < self.k], i[rank < self.k], s[rank < self.k]

    def frames(self):
        if self.waiting:
            q, i, s = self._best()
            yield pd.DataFrame({"qid": q, "id": i, "score": s})


def keyword_lane(chunks: DataFrame, query: str, k: int, analyzer=terms, text: str = "search_text") -> DataFrame:
    """id and score of the k best rows that have every term of the query, by BM25 over all rows. No term, no rows. Texts are read once: lengths and
    counts of the query's terms are kept while the statistics are taken; the k rows come back as a local table."""
    spark = chunks.sparkSession
    asked = spark.range(0, 1, 1, 1).select(F.array_distinct(analyzer(F.lit(query))).alias("t")).first()["t"]
    if not asked:
        return chunks.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    words = chunks.select("id", analyzer(F.col(text)).alias("w")).withColumn("n", F.size("w"))
    counts = words
    for i, t in enumerate(asked):
        counts = counts.withColumn(f"tf{i}", F.size(F.filter("w", _equals(t))))
    counts = counts.drop("w").persist()
    stats = counts.agg(F.count("*").alias("N"), F.avg("n").alias("mean"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(asked))]).first()
    score = F.lit(0.0)
    for i in range(len(asked)):
        idf = float(np.log(1 + (stats["N"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)))
        c = F.col(f"tf{i}").cast("double")
        score = score + F.lit(idf) * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("n") / F.lit(float(stats["mean"] or 1.0))))
    every = reduce(lambda a, b: a & b, [F.col(f"tf{i}") > 0 for i in range(len(asked))])
    top = counts.where(every).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
    found = spark.createDataFrame(top.collect(), top.schema)
    counts.unpersist()
    return found


def inverted_index(chunks: DataFrame, analyzer=terms, text: str = "search_text") -> tuple[DataFrame, DataFrame]:
    """What indexed_keyword_lane reads: postings (term, id, tf) and lengths (id, n). To be written: each file of postings is sorted by term, so that a
    query reads few row groups of it; they are shuffled once."""
    words = chunks.select("id", analyzer(F.col(text)).alias("w"))
    found = words.select("id", F.explode("w").alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))
    return found.sortWithinPartitions("term", "id"), words.select("id", F.size("w").alias("n"))


def indexed_keyword_lane(postings: DataFrame, lengths: DataFrame, query: str, k: int, analyzer=terms) -> DataFrame:
    """keyword_lane() from an index: only the postings of the query's terms are read, and no text."""
    asked = postings.sparkSession.range(0, 1, 1, 1).select(F.array_distinct(analyzer(F.lit(query))).alias("t")).first()["t"]
    if not asked:
        return lengths.where(F.lit(False)).select("id", F.lit(0.0).alias("score"))
    own = postings.where(F.col("term").isin(asked))
    df = {r["term"]: r["df"] for r in own.groupBy("term").agg(F.count("*").alias("df")).collect()}  # a row for each term of the query
    whole = lengths.agg(F.count("*").alias("N"), F.avg("n").alias("mean")).first()
    counts = own.groupBy("id").agg(F.count("*").alias("terms"), *[F.sum(F.when(F.col("term") == t, F.col("tf"))).alias(f"tf{i}") for i, t in enumerate(asked)])
    score = F.lit(0.0)
    for i, t in enumerate(asked):
        idf = float(np.log(1 + (whole["N"] - df.get(t, 0) + 0.5) / (df.get(t, 0) + 0.5)))
        c = F.col(f"tf{i}").cast("double")
        score = score + F.lit(idf) * c * (K1 + 1) / (c + K1 * (1 - B + B * F.col("n") / F.lit(float(whole["mean"] or 1.0))))
    return counts.where(F.col("terms") == len(asked)).join(lengths, "id").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _equals(term: str):
    return lambda x: x == F.lit(term)


def section_lane(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """id, score (1.0), token_overlap and page_start of the k rows whose section number, topic or title the query names."""
    spark = chunks.sparkSession
    q = spark.range(0, 1, 1, 1).select(section_numbers(F.lit(query)).alias("s"), content_tokens(F.lit(query)).alias("t")).first()
    low = query.lower()
    topic, title, head = F.coalesce("topic", F.lit("")), F.coalesce("title", F.lit("")), F.left(F.coalesce("search_text", F.lit("")), F.lit(200))
    tests = []
    for s in q["s"]:
        tests.append((F.col("section_id") == s) | F.col("node_id").startswith(s) | topic.startswith(s + " ") | topic.startswith(s + ".") | head.contains(s + " ") | head.contains(s + "\n"))
    if len(low) >= 4:
        tests.append(F.lower(topic).contains(low) | F.lower(title).contains(low))
    hits = [F.lower(title).contains(t) | F.lower(topic).contains(t) for t in q["t"]]
    tests += hits
    if not tests:
        return chunks.where(F.lit(False)).select("id", F.lit(1.0).alias("score"), F.lit(0).alias("token_overlap"), "page_start")
    overlap = sum((h.cast("int") for h in hits), F.lit(0))
    found = chunks.where(F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False)))
    return found.select("id", F.lit(1.0).alias("score"), overlap.alias("token_overlap"), "page_start").orderBy(F.desc("token_overlap"), F.asc_nulls_last("page_start"), "id").limit(k)


def ranked(lane: DataFrame, name: str, *order: Column) -> DataFrame:
    """id, lane_ord and rank (from 0) of a lane of at most a few rows."""
    by = Window.orderBy(*(order or (F.desc("score"), F.col("id"))))
    return lane.select("id", F.lit(LANES.index(name)).alias("lane_ord"), (F.row_number().over(by) - 1).alias("rank"))


def reciprocal_rank_fusion(lanes: DataFrame, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """lanes: id, lane_ord, rank (and by). Sum of 1/(k + rank + 1) for each id, and first_seen for ties."""
    keys = [*by, "id"]
    out = lanes.groupBy(*keys).agg(F.sum(1.0 / (F.lit(float(k)) + F.col("rank") + 1)).alias("rrf"), F.min(F.struct("lane_ord", "rank")).alias("first_seen"))
    return out.withColumn("rrf", F.round("rrf", 12))


def parent_map(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """id and the struct parent of those of ids that have one."""
    some = chunks.select("id", "parent_id").join(ids.select("id"), "id", "left_semi").where("parent_id is not null")
    title = F.coalesce(F.nullif("title", F.lit("")), "topic", F.lit(""))
    parent = chunks.select(F.col("id").alias("parent_id"), F.struct(F.col("id").alias("id"), title.alias("title"), F.coalesce("section_id", F.lit("")).alias("section_id"), "page_start", "page_end").alias("parent"))
    return some.join(parent, "parent_id").select("id", "parent")


def drop_covered_parents(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """fused (id, ...) without parents of which a child is in it too; children get the struct parent."""
    known = fused.join(chunks.select("id", "is_parent"), "id", "left")
    parents = parent_map(chunks, fused)
    covered = parents.select(F.col("parent.id").alias("id")).distinct().withColumn("covered", F.lit(True))
    out = known.join(covered, "id", "left").where(~(F.coalesce("is_parent", F.lit(False)) & F.coalesce("covered", F.lit(False))))
    return out.drop("covered", "is_parent").join(parents, "id", "left")


def hybrid(chunks: DataFrame, query: str, vector: list[float], top_k: int = 10, kind: str = "general", rrf_k: int = 60, keyword: DataFrame | None = None) -> DataFrame:
    """The fused list: id, rrf, first_seen, parent, in order. keyword: that lane's rows (id, score), where an index has them."""
    lanes = [ranked(section_lane(chunks, query, top_k), "section", F.desc("token_overlap"), F.asc_nulls_last("page_start"), F.col("id"))]
    lanes += [ranked(semantic_lane(chunks, vector, top_k), "semantic"), ranked(keyword_lane(chunks, query, top_k) if keyword is None else keyword, "keyword")]
    if kind in ("formula", "table"):
        lanes.append(ranked(semantic_lane(chunks, vector, top_k, f"{kind}_embedding"), kind))
    fused = reciprocal_rank_fusion(reduce(DataFrame.unionByName, lanes), rrf_k)
    return drop_covered_parents(fused, chunks).orderBy(F.desc("rrf"), "first_seen", "id").limit(top_k)


def parents_in_page_order(chunks: DataFrame, version: str = "v2") -> DataFrame:
    """All parents (null counts as parent, a null version as this one) by page."""
    keep = F.coalesce("is_parent", F.lit(True)) & (F.coalesce("pipeline_version", F.lit(version)) == version)
    return chunks.where(keep).orderBy(F.asc_nulls_last("page_start"), F.asc_nulls_last("page_end"), "id")
