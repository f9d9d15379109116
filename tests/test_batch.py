"""The batched search against single searches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pagewright.operators import batch, retrieval

CHUNK = (
    "document_id string, id string, node_id string, section_id string, title string, topic string, search_text string, page_start int, page_end int, is_parent boolean, parent_id string, "
    "search_embedding array<float>, formula_embedding array<float>, table_embedding array<float>"
)


def test_same_as_single_searches(spark):
    r = random.Random(9)
    words = "magnet coil field flux iron core wire charge motor lamp".split()
    vector = lambda: [r.gauss(0, 1) for _ in range(6)]
    rows = []
    for d in ("d1", "d2"):
        for k in range(40):
            text = " ".join(r.choice(words) for _ in range(r.randrange(3, 30)))
            section = f"{k // 5}.{k}"
            parent = k % 4 == 0
            rows.append((d, f"{d}c{k}", section, section, f"{r.choice(words)} part", f"{section} {r.choice(words)}", f"{section} {text}", k, k, parent, None if parent else f"{d}c{k - k % 4}", vector() if k % 5 else None, vector(), None if k % 2 else vector()))
    chunks = spark.createDataFrame(rows, CHUNK).cache()
    asked = ["magnet coil", "see 3.17 and 0.2", "Flux", "the lamp", "", "of", "motor motor charge", "coil part"]
    queries = [(100 + k, f"d{1 + k % 2}", q, vector(), kind) for k, (q, kind) in enumerate((q, kind) for q in asked for kind in ("general", "formula", "table"))]
    queries += [(900, "d1", "key concepts", vector(), None), (901, "d3", "coil", vector(), None), (902, None, "coil", vector(), None), (903, "d2", "coil", None, "general"), (904, "d1", "coil formula", vector(), None)]
    table = spark.createDataFrame(queries, "qid long, document_id string, query string, embedding array<double>, kind string")
    got: dict[int, list] = {}
    for x in batch.hybrid_batch(chunks, table, 6).orderBy("qid", "rank").collect():
        got.setdefault(x["qid"], []).append((x["id"], x["rrf"] and round(x["rrf"], 9), x["parent_id"]))
    for qid, document, query, embedding, kind in queries:
        own = chunks.where(F.col("document_id") == document)
        if qid == 900:
            want = [(x["id"], None, None) for x in retrieval.parents_in_page_order(own.withColumn("pipeline_version", F.lit("v2"))).collect()]
        elif qid in (901, 902):
            want = []
        elif qid == 903:
            continue  # the lanes of words alone
        elif qid % 3 == 0 or qid == 904:  # every single search runs a dozen jobs
            kind = kind or "formula"
            want = [(x["id"], round(x["rrf"], 9), x["parent"] and x["parent"]["id"]) for x in retrieval.hybrid(own, query, embedding, 6, kind).collect()]
        else:
            continue
        assert got.get(qid, []) == want, (qid, query)
    assert len(got[903]) > 0 and len({x[0] for x in got[903]}) == len(got[903])


def test_blocks_and_passes(spark):
    """Small blocks of queries and passes of few vectors give the same."""
    r = random.Random(3)
    rows = [("d", f"c{k}", f"{k}", f"{k}", f"word{k % 4}", "t", f"word{k % 7} x", k, k, True, None, [r.random() for _ in range(3)], None, None) for k in range(30)]
    chunks = spark.createDataFrame(rows, CHUNK).cache()
    queries = spark.createDataFrame([(k, "d", f"word{k % 5}", [r.random() for _ in range(3)]) for k in range(40)], "qid long, document_id string, query string, embedding array<double>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(batch.section_lanes(chunks, queries, 5, block=3)) == rows(batch.section_lanes(chunks, queries, 5))
    assert rows(batch.semantic_lanes(chunks, queries, 5, block=2, broadcast_bytes=300)) == rows(batch.semantic_lanes(chunks, queries, 5))


def test_keyword_lane_in_passes_and_blocks(spark):
    """Passes and blocks of any size give the same rows; no pair of a query and a chunk is shuffled before k of them are kept."""
    r = random.Random(4)
    words = "magnet coil field flux iron core".split()
    chunks = spark.createDataFrame([(f"d{k % 2}", f"c{k}", " ".join(r.choice(words) for _ in range(r.randrange(12)))) for k in range(200)], "document_id string, id string, search_text string").cache()
    queries = spark.createDataFrame([(k, f"d{k % 3}", " ".join(r.sample([*words, "absent"], k % 4))) for k in range(60)], "qid long, document_id string, query string").cache()
    lanes = [sorted(map(tuple, batch.keyword_lanes(chunks, queries, 5, **how).collect())) for how in ({}, {"block": 7, "broadcast_bytes": 500})]
    want = []
    for q in queries.collect():
        best = retrieval.keyword_lane(chunks.where(F.col("document_id") == q["document_id"]), q["query"], 200).collect()
        best = sorted(best, key=lambda x: (-round(x["score"], 9), x["id"]))[:5]
        want += [(q["qid"], x["id"], n) for n, x in enumerate(best)]
    assert lanes[0] == lanes[1] == sorted(want)


def test_section_lane_has_no_pairs(spark):
    """Chunks meet no queries in a join; words, numbers, whole queries of stop words and missing pages give what single searches give."""
    r = random.Random(5)
    words = "magnet magnets coil the of field flux".split()
    rows = []
    for n in range(150):
        text = " ".join(r.choice(words) for _ in range(r.randrange(6)))
        section = f"{n % 7}.{n % 40}"
        rows.append((f"d{n % 2}", f"c{n}", f"{n % 5}.{n % 30}" if n % 3 else None, section if n % 4 else None, text if n % 5 else None, f"{section} {r.choice(words)}", f"{r.choice(words)} see {n % 6}.{n % 20} {text}", n % 50 if n % 6 else None))
    chunks = spark.createDataFrame(rows, "document_id string, id string, node_id string, section_id string, title string, topic string, search_text string, page_start int").cache()
    asked = ["magnet", "the of", "Of the", "coil flux field", "see 3.17", "1.1 and 2.2 magnet", "5.1", "th", "", "absent", None]
    queries = spark.createDataFrame([(n, f"d{n % 3}", asked[n % len(asked)]) for n in range(40)], "qid long, document_id string, query string")
    lane = batch.section_lanes(chunks, queries, 4)
    assert "Join" not in lane._jdf.queryExecution().toString()
    want = []
    for q in queries.collect():
        best = retrieval.section_lane(chunks.where(F.col("document_id") == q["document_id"]), q["query"] or "", 4).collect()
        want += [(q["qid"], x["id"], n) for n, x in enumerate(best)]
    assert sorted(map(tuple, lane.collect())) == sorted(want) and len(want) > 40
    assert sorted(map(tuple, batch.section_lanes(chunks, queries, 4, block=2, broadcast_bytes=200).collect())) == sorted(want)


def test_parents_of_queries_that_share_an_id(spark):
    """Comprehensive queries of one qid are numbered over the parents of all of them."""
    chunks = spark.createDataFrame([(f"d{n % 2}", f"c{n}", "", "", "", "", "", 9 - n, n, True, None, None, None, None) for n in range(6)], CHUNK)
    queries = spark.createDataFrame([(1, "d0", "overview of", None, None), (1, "d1", "overview of", None, None), (2, "d1", "overview of", None, None)], "qid long, document_id string, query string, embedding array<double>, kind string")
    got = sorted((x["qid"], x["rank"], x["id"]) for x in batch.hybrid_batch(chunks, queries, 3).collect())
    assert got == [(1, n + 1, f"c{5 - n}") for n in range(6)] + [(2, n + 1, f"c{5 - 2 * n}") for n in range(3)]
