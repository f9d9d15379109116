"""An inverted-list index of vectors: every row lies in the list of its nearest centroid, a search reads few lists.

The coarse quantiser is spherical k-means on a bounded sample of the rows (``sample``, those of least hash, so reruns agree). Every row that has
a vector is put to its list; lists are folders, so a search prunes to those it asks for, and scores are exact cosines of whole vectors. A list may hold any share
of the rows: it is written by as many tasks as its size asks for. How many lists a search needs is measured when the index is built: rows of a
sample are searched exactly, and ``probes`` is what finds ``recall`` of their neighbours. ``search`` asks the ``probes`` nearest lists of each query; with ``exact`` it then
asks those that may still hold a better row, by the triangle inequality of angles and the widest angle in the list, so nothing is lost.

Rows without vector or with one of length zero aren't candidates, null ids neither. Vectors of another length than the first are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store
from .retrieval import Best, semantic_per_query

#: A score that isn't above the k-th by this part may still tie with it after rounding.
SLACK = 1e-8


@dataclass(frozen=True)
class VectorParams:
    """lists: how many, at most (0: the root of the rows, between 1 and 4096). sample: rows that the quantiser is fitted on, at most; rounds: of k-means.
    file_rows: rows of a list that one task writes, about. probes: lists asked for each query; 0: so many as give the recall of tested sample rows their tested_k nearest.
    broadcast_bytes: of query vectors at once."""

    lists: int = 0
    sample: int = 20_000
    rounds: int = 12
    file_rows: int = 200_000
    probes: int = 0
    recall: float = 0.97
    tested: int = 128
    tested_k: int = 10
    broadcast_bytes: int = 64 << 20


@dataclass(frozen=True)
class VectorIndex:
    """rows: list, id, embedding; lists: list, centroid, n, least (the least cosine between the centroid and a row of the list); probes: lists that a search asks."""

    rows: DataFrame
    lists: DataFrame
    probes: int


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which had a length."""
    m = np.array(list(vectors), np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1)
    return m[norm > 0] / norm[norm > 0][:, None], norm > 0


def fit(rows: DataFrame, p: VectorParams = VectorParams()) -> np.ndarray:
    """Centroids (of length one) by spherical k-means on the sample, which the driver holds."""
    usable = rows.where("embedding is not null and id is not null")
    lists = p.lists or int(min(4096, max(1, usable.count() ** 0.5)))
    chosen = usable.select("embedding", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(p.sample).toPandas()
    x, _ = _unit(chosen["embedding"])
    if not len(x):
        return np.zeros((0, 0))
    c = np.unique(x, axis=0)
    c = c[np.random.default_rng(0).permutation(len(c))[:lists]]
    for _ in range(p.rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1)
        c = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], c)
    return c


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """id, embedding, list and cos (to the list's centroid) of every row with a vector."""
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for frame in frames:
            x, there = _unit(frame["embedding"])
            frame = frame[there]
            if not len(frame):
                continue
            near = np.concatenate([(x[k : k + 1024] @ c.T).argmax(axis=1) for k in range(0, len(x), 1024)])
            yield frame.assign(list=near.astype(np.int32), cos=np.einsum("ij,ij->i", x, c[near]))

    usable = rows.where("embedding is not null and id is not null").select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    return usable.mapInPandas(run, "id long, embedding array<float>, list int, cos double")


def build(rows: DataFrame, path: str, p: VectorParams = VectorParams()) -> VectorIndex:
    """Write the index of rows (id long, embedding) under path and read it back."""
    spark = rows.sparkSession
    centroids = fit(rows, p)
    if not len(centroids):
        spark.createDataFrame([], "id long, embedding array<float>, cos double, list int").write.mode("overwrite").parquet(f"{path}/rows")
        spark.createDataFrame([], "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/lists")
        spark.createDataFrame([(1,)], "probes int").write.mode("overwrite").json(f"{path}/settings")
        return read(spark, path)
    pd_lists = pd.DataFrame({"list": np.arange(len(centroids), dtype=np.int32), "centroid": centroids.tolist()})
    spark.createDataFrame(pd_lists, "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/lists")
    _put(rows, centroids, path, "overwrite", p)
    spark.createDataFrame([(p.probes or len(centroids),)], "probes int").write.mode("overwrite").json(f"{path}/settings")
    if not p.probes:
        spark.createDataFrame([(_needed(read(spark, path), centroids, p),)], "probes int").write.mode("overwrite").json(f"{path}/settings")
    return read(spark, path)


def _needed(index: VectorIndex, centroids: np.ndarray, p: VectorParams) -> int:
    """How many lists hold p.recall of the neighbours of sample rows."""
    asked = index.rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(p.tested).select(F.col("id").alias("qid"), "embedding")
    asked = store.written(asked, "tested")
    near = semantic_per_query(index.rows.select("id", "embedding"), asked, p.tested_k + 1).where("qid <> id").select("qid", "id")
    where = index.rows.select("id", "list").join(F.broadcast(near), "id").select("qid", "list").toPandas()  # at most tested * tested_k rows
    own = asked.toPandas()
    if not len(where):
        return 1
    q, _ = _unit(own["embedding"])
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1, kind="stable"), axis=1)  # of each list, by nearness
    at = dict(zip(own["qid"].tolist(), place, strict=True))
    ranks = np.sort([at[q][n] for q, n in zip(where["qid"].tolist(), where["list"].tolist(), strict=True)])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(p.recall * len(ranks))) - 1)]) + 1


def add(rows: DataFrame, path: str, p: VectorParams = VectorParams()) -> VectorIndex:
    """Put further rows to the lists of the index under path."""
    spark = rows.sparkSession
    found = spark.read.parquet(f"{path}/lists").orderBy("list").collect()  # at most 4096 rows, or p.lists
    if not found:
        raise ValueError("an index of no rows has no lists: build it")
    _put(rows, np.array([r["centroid"] for r in found]), path, "append", p)
    return read(spark, path)


def _put(rows: DataFrame, centroids: np.ndarray, path: str, mode: str, p: VectorParams) -> None:
    dealt = store.written(assign(rows, centroids), "assigned")
    sizes = dealt.groupBy("list").agg(F.ceil(F.count("*") / p.file_rows).alias("files"))
    # a large list is dealt to several tasks by a hash of its ids
    salted = dealt.join(F.broadcast(sizes), "list").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("files")))
    salted.repartition("list", "salt").sortWithinPartitions("list", "id").select("list", "id", "embedding", "cos").write.mode(mode).partitionBy("list").parquet(f"{path}/rows")


def read(spark: SparkSession, path: str) -> VectorIndex:
    rows = spark.read.schema("id long, embedding array<float>, cos double, list int").parquet(f"{path}/rows")
    sizes = rows.groupBy("list").agg(F.count("*").alias("n"), F.min("cos").alias("least"))
    probes = spark.read.schema("probes int").json(f"{path}/settings").first()["probes"]
    return VectorIndex(rows, spark.read.parquet(f"{path}/lists").join(sizes, "list"), probes)


def search(index: VectorIndex, queries: DataFrame, k: int, p: VectorParams = VectorParams(), exact: bool = False) -> DataFrame:
    """qid, id, score, rank: the k best rows of each query (qid, embedding) in the lists asked. Query vectors are broadcast in passes of a bounded size; what a pass found
    is written before the next, and its broadcast is freed."""
    spark = queries.sparkSession
    lists = index.lists.orderBy("list").toPandas()
    asked = queries.where("embedding is not null and qid is not null").select("qid", "embedding")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not size["n"] or not len(lists):
        return spark.createDataFrame([], "qid long, id long, score double, rank int")
    passes = -(-size["n"] * 8 * size["d"] // p.broadcast_bytes)
    found = [_pass(index, lists, asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == n), k, p, exact) for n in range(passes)]
    return reduce(DataFrame.unionByName, found)


def _pass(index: VectorIndex, lists: pd.DataFrame, queries: DataFrame, k: int, p: VectorParams, exact: bool) -> DataFrame:
    own = queries.toPandas()
    q, there = _unit(own["embedding"]) if len(own) else (np.zeros((0, 1)), np.zeros(0, bool))
    qids = own["qid"].to_numpy(np.int64)[there]
    centroids = np.array(lists["centroid"].tolist())
    numbers = lists["list"].to_numpy()
    near = np.clip(q @ centroids.T, -1, 1) if len(q) else np.zeros((0, len(numbers)))
    probes = min(p.probes or index.probes, len(numbers))
    first = np.zeros(near.shape, bool)
    np.put_along_axis(first, np.argpartition(-near, probes - 1, axis=1)[:, :probes], True, axis=1)
    best = _top(_asked(index, numbers, qids, q, first, k), k)
    if not exact:
        return best
    kth = best.where(F.col("rank") == k).select("qid", "score").toPandas().set_index("qid")["score"]
    least = kth.reindex(qids).fillna(-2.0).to_numpy()
    # no row of a list is nearer than the angle to its centroid less the widest angle in it
    bound = np.cos(np.maximum(0, np.arccos(near) - np.arccos(np.clip(lists["least"].to_numpy(), -1, 1))))
    rest = ~first & (bound + SLACK >= least[:, None])
    return _top(best.drop("rank").unionByName(_asked(index, numbers, qids, q, rest, k)), k)


def _top(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return store.written(found.withColumn("rank", rank).where(F.col("rank") <= k), "nearest")


def _asked(index: VectorIndex, numbers: np.ndarray, qids: np.ndarray, q: np.ndarray, asked: np.ndarray, k: int) -> DataFrame:
    """k rows at most of each task and query: qid, id, score."""
    spark = index.rows.sparkSession
    by_list = {int(n): np.flatnonzero(asked[:, j]) for j, n in enumerate(numbers) if asked[:, j].any()}
    held = spark.sparkContext.broadcast((qids, q, by_list))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, by_list = held.value
        kept = Best(k)
        for frame in frames:
            for number, part in frame.groupby("list", sort=False):
                rows, (x, _) = by_list[number], _unit(part["embedding"])
                for low in range(0, len(rows), 512):
                    own = rows[low : low + 512]
                    kept.add(qids[own], part["id"].to_numpy(), q[own] @ x.T)
        yield from kept.frames()

    rows = index.rows.where(F.col("list").isin(list(by_list)) if by_list else F.lit(False)).select("list", "id", "embedding")
    return rows.mapInPandas(run, "qid long, id long, score double")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, and the share of the rows of exact (qid, id) that found has."""
    hits = exact.select("qid", "id").join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    return hits.agg(F.count_distinct("qid").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
