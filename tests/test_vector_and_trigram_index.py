"""The vector index against an exact scan, the trigram index against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions.text import trigram_similarity
from pagewright.operators import retrieval, trigram_index, vector_index

KIND = "id long, embedding array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Clusters, a third of the rows equal, vectors of no length, nulls."""
    r = np.random.default_rng(4)
    middle = r.normal(size=(12, 16))
    rows = [(k, [float(x) for x in (middle[0] if k % 3 == 0 else middle[k % 12] + 0.5 * r.normal(size=16))]) for k in range(900)]
    rows += [(1000, None), (1001, [0.0] * 16), (None, [1.0] * 16), (1002, [-x for x in rows[1][1]])]
    return spark.createDataFrame(rows, KIND).repartition(4).cache()


def found(df):
    return sorted((r["qid"], r["rank"], r["id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("p", [{"lists": 20, "probes": 2}, {"lists": 1}, {"lists": 9, "probes": 1, "broadcast_bytes": 900, "file_rows": 10}])
def test_exact_search(spark, vectors, tmp_path, p):
    p = vector_index.VectorParams(**p)
    index = vector_index.build(vectors, str(tmp_path), p)
    asked = vectors.where("id % 20 = 0 or id > 990").select(F.col("id").alias("qid"), "embedding")
    want = found(retrieval.semantic_per_query(vectors.where("id is not null"), asked, 7))
    assert found(vector_index.search(index, asked, 7, p, exact=True)) == want
    assert index.rows.count() == 901 and index.lists.agg(F.sum("n")).first()[0] == 901
    some = vector_index.search(index, asked, 7, p)
    r = vector_index.recall(some, spark.createDataFrame([(q, i) for q, _, i, _ in want], "qid long, id long")).first()
    assert r["queries"] == 46 and r["recall"] >= (0.9 if p.lists == 20 else 0.3)


def test_recall_and_pruning(spark, small, tmp_path):
    """0.9 of the exact result with the lists that the index found it needs; a search for one vector reads the folders of its lists only."""
    e = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    index = vector_index.build(e, str(tmp_path))
    asked = e.where("id % 20 = 0").withColumnRenamed("id", "qid")
    r = vector_index.recall(vector_index.search(index, asked, 10), retrieval.semantic_per_query(e, asked, 10)).first()
    assert r["recall"] >= 0.9
    lists = index.lists.count()
    assert 1 < index.probes < lists
    rows = index.rows.where(F.col("list").isin([1, 2]))
    assert {f.split("list=")[1].split("/")[0] for f in rows.inputFiles()} >= {"1", "2"} and "PartitionFilters: [list" in rows._jdf.queryExecution().toString()
    read = rows.count()
    assert read < 0.3 * e.count()


def test_growing_index(spark, vectors, tmp_path):
    p = vector_index.VectorParams(lists=10, probes=3)
    vector_index.build(vectors.where("id < 600"), str(tmp_path), p)
    index = vector_index.add(vectors.where("id >= 600"), str(tmp_path), p)
    asked = vectors.where("id % 50 = 0").select(F.col("id").alias("qid"), "embedding")
    assert found(vector_index.search(index, asked, 5, p, exact=True)) == found(retrieval.semantic_per_query(vectors.where("id is not null"), asked, 5))


def test_index_of_nothing(spark, vectors, tmp_path):
    asked = vectors.select(F.col("id").alias("qid"), "embedding")
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], KIND)
    index = vector_index.build(none, str(tmp_path / "a"))
    assert vector_index.search(index, asked, 3).collect() == [] and index.rows.count() == 0
    with pytest.raises(ValueError, match="build"):
        vector_index.add(vectors, str(tmp_path / "a"))
    index = vector_index.build(vectors, str(tmp_path / "b"))
    assert vector_index.search(index, asked.where("false"), 3).collect() == []
    assert vector_index.search(index, none.withColumnRenamed("id", "qid"), 3).collect() == []


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_similar(spark, tmp_path, least):
    texts = ["the thing and that", "That thing, and the", "thing", "things", "a", "", None, "...", "the other thing " * 9, "unrelated words here", "words here unrelated", "12 34", "éé thing", "thinge"] + [f"common start number {k}" for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)) + [(None, "thing")], "id long, text string")
    asked = rows.select(F.col("id").alias("qid"), "text").where("qid % 2 = 0 or qid is null")
    every = rows.where("id is not null").crossJoin(asked.where("qid is not null").withColumnRenamed("text", "q")).select("qid", "id", F.round(trigram_similarity(F.col("text"), F.col("q")), 9).alias("s"))
    want = sorted(tuple(r) for r in every.where(F.col("s") >= least).collect())
    index = trigram_index.build(rows, str(tmp_path))
    for most in (0, 1_000_000):
        got = trigram_index.similar(index, asked, least, max_broadcast=most)
        assert sorted((r["qid"], r["id"], round(r["similarity"], 9)) for r in got.collect()) == want
    assert len(want) > 20


def test_similar_is_bounded(spark, tmp_path):
    rows = spark.createDataFrame([], "id long, text string")
    index = trigram_index.build(rows, str(tmp_path))
    assert trigram_index.similar(index, spark.createDataFrame([(1, "thing")], "qid long, text string"), 0.3).collect() == []
    with pytest.raises(ValueError, match="least"):
        trigram_index.similar(index, rows.withColumnRenamed("id", "qid"), 0.0)
