"""Search with block maxima against the exhaustive lane."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagewright.operators import keyword_index, retrieval


@pytest.fixture(scope="module")
def texts(spark):
    """Words of Zipf's frequencies, rows of very different length, a third of the rows equal, rows without words or text."""
    r = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    some = lambda n: " ".join(words[min(59, int(r.paretovariate(0.7)))] for _ in range(n))
    same = "w1 w2 w3 w4 w1"
    rows = [(k, same if k % 3 == 0 else some(r.choice([1, 5, 40, 300]))) for k in range(900)]
    rows += [(1000, None), (1001, ""), (1002, "..."), (1003, "w59 w1 w2")]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "id long, search_text string").repartition(5).cache()


@pytest.fixture(scope="module")
def index(texts, tmp_path_factory):
    return keyword_index.build(texts, width=16, buckets=4).write(str(tmp_path_factory.mktemp("index")))


def rows(df):
    return [(r["id"], round(r["score"], 9)) for r in df.collect()]


@pytest.mark.parametrize("k", [1, 3, 20, 2000])
@pytest.mark.parametrize("query", ["w1 w2", "w1", "w59 w1", "w3 w7 w11", "w1 nothere", "...", "W2, w2!"])
def test_same_as_exhaustive(texts, index, query, k):
    assert rows(keyword_index.search(index, query, k)) == rows(retrieval.keyword_lane(texts, query, k))


def test_reads_less(index):
    """Few blocks are scored for a rare word with a common one; the statistics are those of all rows."""
    for query, k in (("w59 w1", 1), ("w1", 3), ("w40 w1", 3)):
        _, chosen = keyword_index._search(index, query, k)
        read, all_ = chosen.agg(F.sum("n")).first()[0], index.blocks.where(F.col("term").isin(query.split())).agg(F.sum("n_docs")).first()[0]
        assert read < 0.25 * all_
    assert index.blocks.agg(F.max("n_docs")).first()[0] <= 16
    s = index.stats.first()
    assert s["n_docs"] == 904 and index.rows.agg(F.max("doc")).first()[0] == 903
    plan = index.blocks.where("term in ('w1')").groupBy("block").agg(F.sum("n_docs"))._jdf.queryExecution().toString()
    assert "postings" not in plan.rsplit("ReadSchema", 1)[1].split("\n")[0]


def test_numbered(spark):
    ids = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("id")).distinct().repartition(7)
    got = keyword_index.numbered(ids).collect()
    assert [r["doc"] for r in sorted(got, key=lambda r: r["id"])] == list(range(len(got)))


def test_blocks_of_many_parts(spark, monkeypatch):
    """Repeated ids, rows without words and blocks over many parts; the postings themselves are not shuffled: the texts' exchange is the only one of the blocks."""
    monkeypatch.setattr(keyword_index, "PART_WORDS", 20)
    r = random.Random(5)
    rows = [(f"k{r.randrange(150)}", " ".join(r.choice("abcdefg") for _ in range(r.randrange(9)))) for _ in range(300)]
    built = keyword_index.build(spark.createDataFrame(rows, "id string, search_text string").repartition(3), width=4)
    ids = sorted({i for i, _ in rows})
    words = {i: [w for j, t in rows if j == i for w in t.split()] for i in ids}
    want = {(w, n // 4, n, words[i].count(w), len(words[i])) for n, i in enumerate(ids) for w in words[i]}
    found = [(b["term"], b["block"], *p) for b in built.blocks.collect() for p in b["postings"]]
    assert len(found) == len(want) and set(found) == want
    plan = built.blocks._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "Exchange rangepartitioning" not in plan


def test_blocks_are_counted_one_by_one(spark):
    """Blocks go on over batches, repeated ids count as one row, rows lack words: the same blocks as by hand. No words or postings are hashed or sorted by Spark, which spilled."""
    r = random.Random(7)
    rows = sorted((r.randrange(90), [r.choice("abcde") for _ in range(r.randrange(6))]) for _ in range(200))
    data = pa.table({"doc": pa.array([d for d, _ in rows], pa.int64()), "w": pa.array([w for _, w in rows], pa.list_(pa.string()))})
    words = {d: sum((w for e, w in rows if e == d), []) for d, _ in rows}
    want = sorted((t, d // 8, d, words[d].count(t), len(words[d])) for d in words for t in set(words[d]))
    for size in (1, 3, 17, 500):
        blocks = [b for x in keyword_index.block_maker(8, 2.5)(iter(data.to_batches(max_chunksize=size))) for b in x.to_pylist()]
        assert sorted((b["term"], b["block"], *p.values()) for b in blocks for p in b["postings"]) == want
        assert len(blocks) == len({(b["term"], b["block"]) for b in blocks})
        for b in blocks:
            assert b["n_docs"] == len(b["postings"]) and b["n_words"] == sum(p["tf"] for p in b["postings"])
            assert b["peak"] == max(keyword_index.weight(p["tf"], p["n"], 2.5) for p in b["postings"])
    plan = keyword_index.build(spark.createDataFrame([(1, "a b")], "id long, search_text string")).blocks._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
