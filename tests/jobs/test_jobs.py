"""The jobs: registered queries against DuckDB, reruns, growing input, revised pages, awkward rows, command lines."""

from __future__ import annotations

import json
import logging
import re
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import build_keyword_index, common, ingest_pages, queries
from pagewright.operators import keyword_index

ROOT = Path(__file__).resolve().parent.parent.parent


def value(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{small}/documents.parquet'")
    found = c.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr([value(r[c]) for c in columns]) for r in df.collect())
    assert got and got == sorted(repr([value(x) for x in r]) for r in found.fetchall())


# --- the index -------------------------------------------------------------------------------------------------------


def test_index_reruns(spark, tmp_path):
    rows = [(1, "The cat. the dog", "x"), (2, None, "x"), (3, "", "x"), (None, "lost words", "x"), (4, "dog  dog\n\n\n\ncat", "x"), (4, "bird", "y"), (9, "w " * 5000, "y")]
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "doc_id long, text string, term string").write.parquet(path)
    out = str(tmp_path / "out")
    first = Counter(build_keyword_index.run(spark, path, out, {"width": 2, "buckets": 3}).collect())
    assert first == Counter(build_keyword_index.run(spark, path, out, {"width": 2, "buckets": 3}).collect())
    assert {(r["term"], r["block"]): r["n_docs"] for r in first} == {("the", 0): 1, ("cat", 0): 1, ("cat", 1): 1, ("dog", 0): 1, ("dog", 1): 1, ("bird", 1): 1, ("w", 2): 1}
    index = keyword_index.read(spark, out)
    assert [r["id"] for r in keyword_index.search(index, "dog cat", 5).collect()] == [4, 1]
    assert {p.name.split("=")[0] for p in (tmp_path / "out" / "blocks").iterdir() if p.is_dir()} == {"bucket"}
    spark.createDataFrame([(5, "new", "x")], "doc_id long, text string, term string").write.mode("append").parquet(path)
    grown = build_keyword_index.run(spark, path, out, {"width": 2, "buckets": 3})
    assert {r["term"] for r in grown.collect()} == {r["term"] for r in first} | {"new"}


def test_index_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    assert build_keyword_index.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect() == []


# --- the stream ------------------------------------------------------------------------------------------------------

KIND = "doc_id long, text string, lang string, source string, digest string"


def put(spark, folder, name, rows):
    part = folder / f"_{name}"
    spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(str(part))
    (folder / name).mkdir(parents=True, exist_ok=True)
    shutil.copy(next(part.glob("*.parquet")), folder / f"{name}.parquet")
    shutil.rmtree(part)
    (folder / name).rmdir()


def batches(out):
    return sorted(int(p.name.split("=")[1]) for p in (out / "pages").glob("bucket=*/batch=*"))


def test_growing_input(spark, tmp_path, caplog):
    source, out, mark = tmp_path / "in", tmp_path / "out", str(tmp_path / "mark")
    source.mkdir()
    run = lambda: {r["doc_id"]: r for r in ingest_pages.run(spark, str(source), str(out), mark, {"buckets": 4}).collect()}
    put(spark, source, "a", [(1, "one  page 3.4", "en", "s", "x"), (2, None, None, None, "x"), (3, "", "de", "t", "x"), (None, "lost", "en", "s", "x"), (4, "rep", "en", "s", "x"), (4, "eated", "en", "s", "x")])
    with caplog.at_level(logging.INFO, logger="ingest_pages"):
        first = run()
    assert re.search(r"batch 0: read 6 rows, wrote 4 page versions .* rejected 1", caplog.text)
    assert set(first) == {1, 2, 3, 4} and first[1]["n_words"] == 4 and first[1]["n_sections"] == 1 and first[1]["pages"] == 2
    assert first[2]["document_id"] is None and first[2]["pages"] == 1 and first[3]["low_prose"]
    assert run() == first and set(batches(out)) == {0}
    # new, the same again with other white space, revised, moved to another document
    put(spark, source, "b", [(5, "five", "en", "u", "x"), (1, "one page   3.4", "en", "s", "x"), (4, "rep eated", "en", "s", "x"), (3, "", "de", "s", "x")])
    caplog.clear()
    with caplog.at_level(logging.INFO, logger="ingest_pages"):
        second = run()
    assert "batch 1: read 4 rows, wrote 3 page versions" in caplog.text
    assert set(second) == {1, 2, 3, 4, 5} and second[4]["n_words"] == 2 and second[1]["digest"] == first[1]["digest"]
    assert second[3]["document_id"] == "s" and second[3]["pages"] == 3
    gone = ingest_pages.totals(spark, str(out)).where("document_id = 't'").collect()
    assert [(r["pages"], r["words"]) for r in gone] == [(0, 0)]
    versions = spark.read.parquet(str(out / "pages"))
    assert Counter(r["doc_id"] for r in versions.collect()) == {1: 1, 2: 1, 3: 2, 4: 2, 5: 1}
    assert spark.read.parquet(str(out / "rejected")).count() == 1
    assert run() == second and versions.count() == spark.read.parquet(str(out / "pages")).count()
    # one run over all files in one batch ends with the same pages
    whole = {r["doc_id"]: r for r in ingest_pages.run(spark, str(source), str(tmp_path / "all"), str(tmp_path / "mark2"), {"files_per_batch": 1}).collect()}
    assert {k: v["digest"] for k, v in whole.items()} == {k: v["digest"] for k, v in second.items()}


def test_batch_again(spark, tmp_path):
    """A batch that is run again, after it wrote all or a part, leaves the same rows."""
    docs = spark.createDataFrame([(k, f"text {k}", "en", f"s{k % 3}", "x") for k in range(30)], KIND)
    out = str(tmp_path / "out")
    state = lambda: (Counter(spark.read.parquet(f"{out}/pages").collect()), Counter(ingest_pages.totals(spark, out).collect()))
    ingest_pages.ingest(docs.where("doc_id < 20"), 0, out, 4)
    ingest_pages.ingest(docs.where("doc_id > 10").withColumn("text", F.concat("text", F.lit("!"))), 1, out, 4)
    before = state()
    shutil.rmtree(f"{out}/totals")
    ingest_pages.ingest(docs.where("doc_id > 10").withColumn("text", F.concat("text", F.lit("!"))), 1, out, 4)
    after = state()
    assert before[0] == after[0] and sum(after[1].values()) == 3
    assert before[1] == after[1]


def test_nothing_to_take(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert ingest_pages.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).collect() == []
    put(spark, tmp_path / "in", "none", [])
    assert ingest_pages.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")).collect() == []


# --- command lines ---------------------------------------------------------------------------------------------------


def test_configs(tmp_path):
    for job in (build_keyword_index, ingest_pages):
        name = job.__name__.split(".")[1]
        assert common.config_of(str(ROOT / "jobs" / f"{name}.json"), job.KNOWN) == job.KNOWN
    (tmp_path / "bad.json").write_text(json.dumps({"widht": 3}))
    with pytest.raises(ValueError, match="widht"):
        common.config_of(str(tmp_path / "bad.json"), build_keyword_index.KNOWN)


@pytest.mark.parametrize("name, more", [("build_keyword_index", []), ("ingest_pages", ["--checkpoint"])])
def test_command_line(small, tmp_path, name, more):
    args = ["--documents", f"{small}/documents.parquet*", "--output", str(tmp_path / "out")]
    for m in more:
        args += [m, str(tmp_path / m.strip("-"))]
    done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *args], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "read 200" in done.stderr and "wrote" in done.stderr
    assert list((tmp_path / "out").rglob("*.parquet"))
