"""Golden cases of records, intervals, alignment, fusion, splitting and storage."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagewright.functions import records as R
from pagewright.operators import alignment, chunks, intervals, retrieval
from pagewright.sources import store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def formula(spark, latex, variables=(), name="", context="", describes=""):
    return F.from_json(F.lit(__import__("json").dumps({"latex": latex, "variables": [{"symbol": s, "meaning": m} for s, m in variables], "name": name, "context": context, "describes": describes})), R.FORMULA)


@pytest.mark.parametrize(
    ("latex", "variables", "problem"),
    [
        ("", (), "empty latex"),
        ("$F=ma$", (), "contains unescaped $ delimiters"),
        ("\\frac{a}{b", (), "unbalanced braces"),
        ("\\begin{array}", (), "mismatched \\begin/\\end environments"),
        ("E=mc^2", (), "symbolic formula has no variable explanations"),
        ("2+2=4", (), ""),
        ("x", (("", "m"),), "variable missing symbol"),
        ("x", (("x", ""),), "variable missing meaning"),
        ("\\$5", (), ""),
    ],
)
def test_formula_problem(spark, latex, variables, problem):
    assert one(spark, R.formula_problem(formula(spark, latex, variables))) == problem


def test_merge_formulas(spark):
    vision = F.array(formula(spark, "F = ma"), formula(spark, "F=ma", name="N2", context="c2"))
    summary = F.array(formula(spark, "F=ma", name="Newton", describes="d"), formula(spark, "E=mc^2"))
    got = one(spark, R.merge_formulas(vision, summary))
    assert [(f["latex"], f["name"], f["context"], f["describes"]) for f in got] == [("F=ma", "N2", "c2", "d"), ("E=mc^2", "", "", "")]


def test_vision_shape(spark):
    got = one(spark, R.parse_vision(F.lit('{"prose_text": "p", "formulas": "none", "key_terms": ["k"]}')))
    assert (got["prose_text"], got["formulas"], got["key_terms"], got["tables"]) == ("p", [], ["k"], [])
    assert one(spark, R.parse_vision(F.lit("no json")))["prose_text"] == ""


@pytest.mark.parametrize(
    ("spans", "problem"),
    [
        ([(0, 40), (40, 100)], ""),
        ([(0, 100)], "single span (no-op)"),
        ([(0, 40), (41, 100)], "span[1] start 41 != previous end 40"),
        ([(0, 40), (40, 99)], "last span ends at 99, expected 100"),
        ([(0, 0), (0, 100)], "span[0] invalid range 0..0"),
        ([(0, 1)] * 6, "too many spans"),
        ([], "no spans"),
    ],
)
def test_span_problem(spark, spans, problem):
    column = F.array(*[F.struct(F.lit(a).alias("start_char"), F.lit(b).alias("end_char")) for a, b in spans]).cast("array<struct<start_char:int,end_char:int>>")
    assert one(spark, R.span_problem(column, F.lit(100))) == problem


def expected_spans(text):
    import re

    n = len(text)
    breaks = [m.end() for m in re.finditer(r"\n\s*\n", text)]
    if n < 800 or not breaks:
        return []
    parts = 3 if n >= 2400 else 2
    cuts = sorted({0, n, *(min(breaks, key=lambda b: abs(b - int(k * n / parts))) for k in range(1, parts))})
    spans = [[a, b] for a, b in zip(cuts, cuts[1:], strict=False) if b - a >= 200]
    if len(cuts) < 3 or len(spans) < 2:
        return []
    spans[0][0], spans[-1][1] = 0, n
    return [tuple(s) for s in spans]


@pytest.mark.parametrize("text", ["x" * 500, ("a" * 300 + "\n \n") * 4, ("word " * 80 + "\n\n\n") * 9, "y" * 900, "z" * 850 + "\n\nend", ("q" * 700 + "\n\n") * 2 + "r" * 2000])
def test_fallback_spans(spark, text):
    got = one(spark, R.fallback_spans(F.lit(text)))
    assert [(s["start_char"], s["end_char"]) for s in got] == expected_spans(text)


@pytest.mark.parametrize(("span", "pages"), [((0, 10), (1, 1)), ((5, 15), (1, 2)), ((11, 15), (1, 2))])
def test_page_range(spark, span, pages):
    offsets = F.array(*[F.struct(F.lit(p).alias("page"), F.lit(s).alias("s"), F.lit(e).alias("e")) for p, s, e in [(1, 0, 10), (2, 12, 20)]])
    assert tuple(one(spark, R.page_range(offsets, F.lit(span[0]), F.lit(span[1]), F.lit(1), F.lit(2)))) == pages


@pytest.mark.parametrize(("n", "pages", "concepts", "gate"), [(799, (1, 9), 0, "too-short"), (800, (1, 3), 0, "wide-span(3p)"), (3000, (1, 1), 0, "long-content(3000)"), (800, (1, 1), 4, "many-concepts(4)"), (800, (1, 1), 0, "below-threshold")])
def test_split_gate(spark, n, pages, concepts, gate):
    none = F.array().cast(f"array<{R.FORMULA}>")
    assert one(spark, R.split_gate(F.lit("x" * n), F.lit(pages[0]), F.lit(pages[1]), F.array_repeat(F.lit("k"), concepts), none)) == gate


LEAF = "document_id string, leaf_pos int, node_id string, title string, section_id string, start_index int, end_index int, summary string"


def test_deoverlap(spark):
    leaves = spark.createDataFrame([("d", k, str(k), "", "", a, b, "") for k, (a, b) in enumerate([(1, 5), (3, 8), (4, 6), (10, 12)])], LEAF)
    got = sorted((r["leaf_pos"], r["new_start"], r["new_end"]) for r in intervals.deoverlap(leaves).collect())
    assert got == [(0, 1, 5), (1, 6, 8), (2, 4, 3), (3, 10, 12)]


def test_narrowest_cover(spark):
    leaves = spark.createDataFrame([("d", 0, "w", "", "", 1, 10, "wide"), ("d", 1, "a", "", "", 2, 4, "n1"), ("d", 2, "b", "", "", 3, 5, "n2"), ("d", 3, "c", "", "", None, 5, "null")], LEAF)
    pages = spark.createDataFrame([("d", 3), ("d", 11), ("d", 40)], "document_id string, page_number int")
    assert {r["page_number"]: r["summary"] for r in intervals.narrowest_cover(pages, leaves).collect()} == {3: "n1", 11: "", 40: ""}


def test_alignment(spark):
    leaves = spark.createDataFrame([("d", 0, "a", "5.1 Intro", "5.1", 1, 3, ""), ("d", 1, "b", "Bar", "5.2", 4, 5, "")], LEAF)
    text = {1: "5.1 INTRO\nx", 5: "6 MAGNETS\nx"}
    pages = spark.createDataFrame([("d", p, text.get(p, "x")) for p in range(1, 8)], "document_id string, page_number int, text string")
    got = [(r["node_id"], r["title"], r["start_index"], r["end_index"]) for r in alignment.corrected_leaves(pages, leaves).orderBy("start_index").collect()]
    assert got == [("a", "5.1 Intro", 1, 3), ("b", "Bar", 4, 4), ("VISION#6", "6 MAGNETS", 5, 7)]
    assert [r["page_number"] for r in alignment.arbitrated(pages, leaves).where("warning is not null").collect()] == [5]


def test_fusion(spark):
    lanes = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("b", 1, 0), ("c", 1, 1)], "id string, lane_ord int, rank int")
    got = {r["id"]: round(r["rrf"], 6) for r in retrieval.reciprocal_rank_fusion(lanes).collect()}
    assert got == {"a": 0.016393, "b": 0.032522, "c": 0.016129}


def test_parent_rule(spark):
    rows = [("P", True, None, "P title"), ("C1", False, "P", "c"), ("Q", True, None, "q")]
    c = spark.createDataFrame(rows, "id string, is_parent boolean, parent_id string, title string").withColumns({"topic": F.lit("t"), "section_id": F.lit("1"), "page_start": F.lit(1), "page_end": F.lit(2)})
    got = {r["id"]: r["parent"] and r["parent"]["id"] for r in retrieval.drop_covered_parents(c.select("id"), c).collect()}
    assert got == {"C1": "P", "Q": None}


def test_lanes_without_candidates(spark):
    c = spark.createDataFrame([("a", "x y", [0.0, 0.0]), ("b", "x", None)], "id string, search_text string, search_embedding array<float>")
    assert retrieval.semantic_lane(c, [1.0, 0.0], 5).collect() == []
    assert retrieval.keyword_lane(c, " . ", 5).collect() == []
    assert [r["id"] for r in retrieval.keyword_lane(c, "y x", 5).collect()] == ["a"]
    with pytest.raises(ValueError):
        retrieval.semantic_lane(c, [1.0, 0.0], 5, "content")


def test_semantic_per_query(spark):
    """Ties, zero and missing vectors, more rows than a batch has queries, and several passes."""
    import numpy as np

    r = np.random.default_rng(5)
    m = r.integers(-2, 3, (300, 6)).astype(float)
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(900, None), (901, [0.0] * 6)]
    c = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    asked = c.where("id % 20 = 0").select(F.col("id").alias("qid"), "embedding")
    norm = np.linalg.norm(m, axis=1)
    want = {}
    for q in range(0, 300, 20):
        if norm[q]:
            score = [(-round(float(m[q] @ m[i] / norm[q] / norm[i]), 9), i) for i in range(300) if norm[i]]
            want[q] = [i for _, i in sorted(score)[:7]]
    for p in ({}, {"block": 4}, {"broadcast_bytes": 200}):
        got = {}
        for x in retrieval.semantic_per_query(c, asked, 7, **p).orderBy("qid", "rank").collect():
            got.setdefault(x["qid"], []).append(x["id"])
        assert got == want


def test_examples(spark):
    """Against the positions of a regular expression; the parting character in a text is a letter as any other."""
    head = re.compile(r"(?m)^\s*(Example\s+\d+(?:\.\d+)?)\b[^\n]*")
    long, mark = "a" * 90, chunks._MARK
    texts = ["intro\n\n  Example 1.2 of it\n" + long + "\nExample 3\nshort\n", None, "", "no example", "Example 1\n" + long, "\n\nExample 2" + long, long + "\nExample 5 " + long + "\n\n \t\nExample\t6.1\u00a0x " + long]
    texts += [f"{mark}\nExample 7 {mark}{long}\nExample 8 {long}\rExample 9 {long}", "é" * 100 + "\n\x0bExample 1 " + long, "x\nExample 12a\nExample 1.2.3 " + long, ("\nExample 4 " + long) * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("i", "t", chunks.piece_list(F.col("t")).alias("p")).collect():
        t = r["t"] or ""
        at = [m.start() for m in head.finditer(t)] + [len(t)]
        want = {(s + len(t[s:e]) - len(t[s:e].lstrip(" \t\n")), e): head.match(t, s)[1].strip() for s, e in zip(at, at[1:])}
        want = {k: v for k, v in want.items() if k[1] - k[0] >= 80}
        assert {(p["s"], p["e"]): p["label"] for p in r["p"] if p["kind"] == "example"} == want, r["i"]
        assert "".join(t[p["s"] : p["e"]] for p in r["p"]) == t and all(p["s"] < p["e"] for p in r["p"])
        assert all(a["kind"] == "example" or b["kind"] == "example" for a, b in zip(r["p"], r["p"][1:]))


def test_store(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, store.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, store.insert_new(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    import hashlib

    assert one(spark, store.cache_key(F.lit("x"))) == hashlib.sha256(b"v3\0x").hexdigest()


def test_streaming_upsert(spark, tmp_path):
    from pagewright.streaming.ingest import upsert_stream

    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1).write.parquet(source)
    start = lambda: upsert_stream(spark.readStream.schema("k int, v string").parquet(source), target, ["k"], str(tmp_path / "check")).awaitTermination()
    start()
    spark.createDataFrame([(2, "c")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
    start()
    assert sorted(map(tuple, spark.read.parquet(f"{target}/v1").collect())) == [(1, "a"), (2, "c")]


def test_engine(spark, tmp_path):
    from pagewright.functions.backends import leading_summary
    from pagewright.plans.engine import Engine, NotFound, NotReady

    root = str(tmp_path / "tables")
    e = Engine(spark, root, summary=leading_summary)
    text = "Magnets attract iron. " * 60
    none = lambda k: F.array().cast(f"array<{k}>")
    pages = spark.createDataFrame([("d", 1, "5.1 INTRO WORDS\n" + text), ("d", 2, text), ("d", 3, "6 COILS AND CURRENTS\n" + "coils and currents " * 40)], "document_id string, page_number int, text string")
    pages = pages.withColumns({"formulas": none(R.FORMULA), "tables": none(R.TABLE), "diagrams": none(R.DIAGRAM), "graphs": none(R.GRAPH), "keywords": F.array(F.lit("k"))})
    with pytest.raises(NotFound):
        e.status("d")
    assert e.ingest("d", pages)["page_count"] == 3
    with pytest.raises(NotReady):
        e.search("d", "magnets")
    leaves = spark.createDataFrame([("d", 0, "a", "Intro", "5.1", 1, 3, "")], LEAF)
    assert e.load_tree("d", leaves) == 1
    first = e.enrich("d")
    assert first["parents"] >= 1 and first["warnings"] >= 1
    # another engine on the same folder, in a session of its own, goes on
    other = Engine(spark.newSession(), root, summary=leading_summary)
    assert other.status("d") == {"document_id": "d", "status": "complete", "page_count": 3, "filename": "unknown.pdf"}
    assert other.search("d", "magnets attract", top_k=3).count() >= 1
    whole = other.search("d", "key concepts")
    assert whole.count() == first["parents"]
    parent = whole.where("page_start = 1").first()
    assert [p["page_number"] for p in parent["pages_data"]] == [1, 2] and parent["pages_data"][0]["text"].startswith("5.1 INTRO")
    assert other.tables.chunks("d").count() == first["parents"] + first["children"]
    with pytest.raises(ValueError):
        other.search("d", "x", kind="nonsense")
    assert other.ingest("d", pages.where("false"))["status"] == "complete"
    history = [r["status"] for r in other.tables.rows("documents", "d").orderBy("batch").collect()]
    assert history == ["vision_done", "tree_uploaded", "complete"]
    about = other.tables.documents("d").first()
    assert about["vision_done_at"] <= about["enriched_at"] <= about["updated_at"] and about["pipeline_version"] == "v2"


def test_upload_and_run(spark, tmp_path):
    """From a file to page records: pages are read once for each content, failed ones aren't cached, a failure marks the document."""
    from pagewright.plans.engine import Engine

    calls = tmp_path / "calls"
    calls.mkdir()
    for name, content in (("a.pdf", b"one|two|bad"), ("b.PDF", b"two|three"), ("c.pdf", b"broken"), ("n.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    where = str(calls)

    def decoder(content, zoom):
        if content == b"broken":
            raise ValueError("no PDF")
        return content.split(b"|")

    def vision(image):
        import json
        import os
        import uuid

        open(os.path.join(where, uuid.uuid4().hex), "w").write(image.decode())
        if image == b"bad":
            raise ValueError("unreadable")
        return json.dumps({"prose_text": f"The text of {image.decode()}.", "key_terms": [image.decode()], "formulas": [{"latex": "$"}]})

    e = Engine(spark, str(tmp_path / "tables"), vision=vision, decoder=decoder)
    with pytest.raises(ValueError, match="Only PDF files"):
        e.upload(str(tmp_path / "n.txt"))
    with pytest.raises(ValueError, match="Only PDF files"):
        e.upload(str(tmp_path / "a.pdf"), "")
    a, b, c = (e.upload(str(tmp_path / n))["document_id"] for n in ("a.pdf", "b.PDF", "c.pdf"))
    assert e.status(a) == {"document_id": a, "status": "pending", "page_count": None, "filename": "a.pdf"}
    assert e.run(a)["page_count"] == 3 and e.run(a)["status"] == "vision_done"
    assert e.run(b)["page_count"] == 2
    read = sorted(p.read_text() for p in calls.iterdir())
    assert read == ["bad", "one", "three", "two"]
    got = e.tables.load_pages(a).collect()
    assert [(r["page_number"], r["text"], r["keywords"], r["formulas"]) for r in got] == [(1, "The text of one.", ["one"], []), (2, "The text of two.", ["two"], []), (3, "", [], [])]
    with pytest.raises(Exception, match="no PDF"):
        e.run(c)
    assert e.status(c)["status"] == "failed"


def test_tables(spark, tmp_path):
    from pagewright.functions.backends import vector_of
    from pagewright.sources.tables import Tables, json_cells

    t = Tables(spark, str(tmp_path / "t"), parts=4)
    assert t.pages("d").collect() == [] and t.documents().collect() == [] and t.cache().collect() == []
    page = lambda *rows: spark.createDataFrame(rows, "document_id string, page_number int, text string, topics array<string>")
    t.save_pages(page(("d", 2, "b", ["x"]), ("d", 1, "a", None), ("e", 1, "z", None), ("d", 1, "longer", None)))
    t.save_pages(page(("d", 2, None, None), ("d", 3, "c", ["y"])))
    rows = t.load_pages("d").collect()
    assert [(r["page_number"], r["text"], r["topics"], r["summary"]) for r in rows] == [(1, "longer", [], ""), (2, "", [], ""), (3, "c", ["y"], "")]
    before = sorted(map(tuple, t.pages().select("document_id", "page_number", "text").collect()), key=str)
    t.compact("pages")
    assert sorted(map(tuple, t.pages().select("document_id", "page_number", "text").collect()), key=str) == before and t.rows("pages").count() == 4
    chunk = lambda *rows: spark.createDataFrame(rows, "document_id string, id string, title string, content string, is_parent boolean, role string")
    counts = t.replace_chunks(chunk(("d", "1", "T", "body", True, "x"), ("d", "2", "U", "part", False, "example"), ("e", "3", "V", "", True, None)), "v2").collect()
    assert sorted(map(tuple, counts)) == [("d", 1, 1), ("e", 1, 0)]
    t.replace_chunks(chunk(("d", "9", "W", "new", True, None)), "v2")
    t.replace_chunks(chunk(("d", "old", "O", "o", True, None)), "v1")
    assert sorted((r["id"], r["topic"], r["search_text"], r["role"]) for r in t.chunks().collect()) == [("3", "V", "", None), ("9", "W", "new", None), ("old", "O", "o", None)]
    t.replace_chunks(chunk(("d", "x", "", "", True, None)).where("false"), "v2", spark.createDataFrame([("e",)], "document_id string"))
    assert {r["id"] for r in t.chunks().collect()} == {"9", "old"}
    flat = json_cells(t.chunks("d").select("id", "formulas", "keywords", "rich_summary").where("id = '9'")).first()
    assert tuple(flat) == ("9", "[]", None, "{}")
    assert one(spark, vector_of(F.lit("[1, 2.5]"), 2)) == [1.0, 2.5]
    with pytest.raises(Exception, match="another dimension"):
        one(spark, vector_of(F.lit("[1]"), 2))


def test_trees(spark):
    import json

    from pagewright.sources import trees

    node = lambda k, *nodes: {"node_id": f"n{k}", "title": f"T {k}", "section_id": str(k), "start_index": k, "end_index": k + 1, "nodes": list(nodes)}
    nested = [node(1, node(2), node(3, node(4))), node(5)]
    bodies = [("a", json.dumps({"tree": nested, "flat_nodes": [node(7), node(6)]})), ("b", json.dumps({"tree": {"title": "Book", "nodes": nested}})), ("c", json.dumps({"tree": nested})), ("d", "no JSON"), ("e", None)]
    got = trees.uploads(spark.createDataFrame(bodies, "document_id string, body string"))
    tree = {r["document_id"]: r["tree"] for r in got.collect()}
    assert json.loads(tree["a"]) == {"nodes": nested} == json.loads(tree["c"]) and json.loads(tree["b"])["title"] == "Book"
    rows = sorted((r["document_id"], r["leaf_pos"], r["node_id"], r["start_index"]) for r in trees.leaves(got).where("node_id is not null").collect())
    assert rows == [("a", 0, "n7", 7), ("a", 1, "n6", 6), *[("b", k, f"n{k}", k) for k in range(1, 6)], *[("c", k, f"n{k + 1}", k + 1) for k in range(5)]]


def test_settings(spark, monkeypatch):
    from pagewright.config import Settings

    monkeypatch.setenv("PAGEWRIGHT_DEFAULT_TOP_K", "3")
    s = spark.newSession()
    s.conf.set("spark.pagewright.enable_concept_split", "false")
    assert (Settings.of(s).default_top_k, Settings.of(s).enable_concept_split, Settings.of(spark).enable_concept_split, Settings.of(s).rrf_k) == (3, False, True, 60)


def test_upsert_of_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (2, None)], "k int, v string")
    for order in ("v", "k"):
        assert sorted(map(tuple, store.upsert(old, new.orderBy(order), ["k"]).collect())) == [(1, "a"), (2, "d")]


def test_chunks_compacted_and_vacuumed(spark, tmp_path):
    """Readers see the same rows after compaction and clean-up; replaced batches go once they are old enough; a reader of the old state finishes meanwhile."""
    import os

    from pagewright.sources.tables import Tables

    t = Tables(spark, str(tmp_path), parts=2)
    made = lambda d, n, text: spark.range(n).select(F.lit(d).alias("document_id"), F.concat(F.lit(d), F.col("id").cast("string")).alias("id"), F.lit(text).alias("title"), F.lit(True).alias("is_parent"))
    for d, n in (("a", 3), ("b", 2), ("c", 4)):
        t.replace_chunks(made(d, n, "old"), "v1")
    t.replace_chunks(made("a", 5, "new"), "v1")
    t.replace_chunks(made("a", 1, "other"), "v2")
    seen = lambda: sorted((r["id"], r["title"], r["pipeline_version"]) for r in t.chunks().collect())
    told = lambda: sorted(map(tuple, t.documents().select("document_id", "status", "created_at", "updated_at", "enriched_at").collect()))
    folders = lambda name: sorted(f for f in os.listdir(tmp_path / name) if f.startswith("batch="))
    before, status = seen(), told()
    assert len(before) == 12 and len(folders("chunks")) == 5
    assert t.vacuum(3600) == [] and len(t.vacuum(0)) == 1 and seen() == before
    reader = t.chunks()
    t.compact("chunks")
    assert len(reader.collect()) == 12  # of the state before
    assert seen() == before and told() == status
    assert t.vacuum(3600) == [] and len(folders("chunks")) == 5
    assert len(t.vacuum(0)) == 4 and len(folders("chunks")) == 1
    assert seen() == before and told() == status
    t.compact("documents")
    assert len(folders("documents")) == 1 and seen() == before and told() == status
    t.replace_chunks(made("b", 1, "newer"), "v1")
    assert ("b0", "newer", "v1") in seen() and len(seen()) == 11
    t.replace_chunks(made("c", 0, ""), "v1", spark.createDataFrame([("c",)], "document_id string"))
    assert len(seen()) == 7 and t.vacuum(0) == []
    t.compact("uploads")


def test_ranges_of_any_length(spark):
    """Against all pairs: ranges from one page to millions; a range is 65 rows at most."""
    import random

    r = random.Random(8)
    ranges = [("d", k, a, a + r.choice([0, 1, 15, 16, 900, 1023, 1024, 1025, 70_000, 5_000_000, 2**31 - 1 - a])) for k, a in enumerate(r.randrange(-50, 200_000) for _ in range(120))]
    ranges += [("d", 500, None, 5), ("d", 501, 9, None), ("d", 502, 9, 8), ("e", 503, 1, 2**31 - 1), ("d", 504, -(2**31), 2**31 - 1)]
    leaves = spark.createDataFrame([(d, k, str(k), "", "", a, b, f"s{k}") for d, k, a, b in ranges], LEAF)
    pages = [("d", r.randrange(-60, 300_000), f"t{k}") for k in range(300)] + [("d", 5, "x"), ("d", 5, "y"), ("e", 7, "z"), ("f", 1, "")]
    table = spark.createDataFrame(pages, "document_id string, page_number int, text string")
    want = sorted((d, p, t, k) for d, p, t in pages for e, k, a, b in ranges if d == e and a is not None and b is not None and a <= p <= b)
    assert sorted((x["document_id"], x["page_number"], x["text"], x["leaf_pos"]) for x in intervals.covering(table, leaves).collect()) == want
    rows = intervals.spread(leaves).groupBy("leaf_pos").count().collect()
    assert max(x["count"] for x in rows) <= 65 and len(rows) == len(ranges) - 3
    first = {(x["document_id"], x["page_number"]): x["leaf"]["leaf_pos"] for x in intervals.first_claim(table, leaves).collect()}
    assert first == {(d, p): min(k for e, q, _, k in want if (e, q) == (d, p)) for d, p, _, _ in want}
    assert {x["document_id"] for x in intervals.orphan_pages(table, leaves).collect()} == {"f"}


def test_layouts(spark, tmp_path):
    """No shuffle in the join of children with parents; a section's rows are in few files, which the scan's statistics find."""
    from pagewright.sources import layout

    rows = [(f"d{k % 3}", f"c{k}", None if k % 5 == 0 else f"c{k - k % 5}", f"{k % 40}.{k}", f"T{k}" if k % 2 else "", "top", k, k) for k in range(400)]
    chunks = spark.createDataFrame(rows, "document_id string, id string, parent_id string, section_id string, title string, topic string, page_start int, page_end int").repartition(5)
    families = layout.by_family(chunks, str(tmp_path / "f"), 4)
    got = layout.parents_of(families)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, retrieval.parent_map(chunks, chunks).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    again = layout.by_family(chunks, str(tmp_path / "g"), 4)
    assert again.count() == families.count() == 400
    sections = layout.by_section(chunks, str(tmp_path / "s"), files=6)
    assert sections.columns == chunks.columns and sections.count() == 400
    one = sections.where("document_id = 'd1' and section_id = '7.247'")
    assert [r["id"] for r in one.collect()] == ["c247"]
    files = lambda df: {r["f"] for r in df.select(F.input_file_name().alias("f")).collect()}
    assert len(files(sections.where("document_id = 'd1'"))) < len(files(sections)) and len(files(one)) == 1


def test_pages_of_few_sources_are_dealt_evenly(spark, tmp_path, monkeypatch):
    """Pages and chunks of one source lie in many partitions; null sources, null and repeated ids keep a page for each row, and parents are as the pages say."""
    from pagewright.plans import views

    monkeypatch.setattr(views, "IDS", 4)
    rows = [(i, f"t{i}", "en", "one") for i in range(60)] + [(i, f"u{i}", "de", None) for i in range(9)] + [(None, "none", "en", "one"), (7, "again", "en", "one"), (7, "more", "en", "one")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(i)]) for i in range(0, 60, 2)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        p = views.pages(spark, str(tmp_path)).withColumn("at", F.spark_partition_id()).collect()
        c = views.chunks(spark, str(tmp_path)).withColumn("at", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert len(p) == len(c) == len(rows)
    assert len({r["at"] for r in p if r["document_id"] == "one"}) > 1 and len({r["at"] for r in c if r["document_id"] == "one"}) > 1
    for source in ("one", None):
        own = sorted(((r["page_number"], r["doc_id"]) for r in p if r["document_id"] == source))
        assert [n for n, _ in own] == list(range(1, len(own) + 1))
        ids = [i for _, i in own]
        assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
        chunks = sorted((r for r in c if r["document_id"] == source), key=lambda r: r["page_start"])
        assert [r["id"] for r in chunks] == [None if i is None else f"c{i}" for i in ids]
        assert [r["parent_id"] for r in chunks] == [None if n % 5 == 0 or ids[n - n % 5] is None else f"c{ids[n - n % 5]}" for n in range(len(ids))]
        assert [r["search_embedding"] for r in chunks] == [[float(i)] if i is not None and i % 2 == 0 else None for i in ids]
    assert sorted(r["search_text"] for r in c) == sorted(t for _, t, _, _ in rows)


def test_enrich_shuffles_few_copies_of_texts(spark):
    """Headings and orphans are told without moving texts, and a text is joined before its clean copy is made: three copies are shuffled, not seven."""
    import random

    r = random.Random(1)
    rows = [("d", n, "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=20_000)), [], [], []) for n in range(1, 61)]
    pages = spark.createDataFrame(rows, f"document_id string, page_number int, text string, formulas array<{R.FORMULA}>, tables array<{R.TABLE}>, keywords array<string>")
    leaves = spark.createDataFrame([("d", n, f"n{n}", f"Section {n}", str(n), 5 * n + 1, 5 * n + 4, "") for n in range(12)], "document_id string, leaf_pos int, node_id string, title string, section_id string, start_index int, end_index int, summary string")
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    adaptive = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        parents, _ = chunks.enrich(pages, leaves, split=False)
        assert parents.agg(F.sum(F.size("pages_data")).alias("n")).first()["n"] == 60
        parents.unpersist()
        copies = (moved() - before) / sum(len(x[2]) for x in rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold") if adaptive is None else spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", adaptive)
    assert copies < 4, copies
