"""Registered queries against DuckDB at the smallest scale."""

from __future__ import annotations

import duckdb
import pytest

from pagewright.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


def value(v):
    return round(v, 8) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, small, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(repr([value(r[c]) for c in columns]) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert got == sorted(repr([value(r[names.index(c)]) for c in columns]) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 3


def test_entry_without_llm(tmp_path):
    """The rest works on a copy without the operators for training data, with and without the pipeline's module."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root / "pagewright", copy / "pagewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copytree(root / "jobs", copy / "jobs", ignore=shutil.ignore_patterns("__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op')]"
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, copy)
    for left in (False, True):
        if left:  # an empty folder that a deletion left behind
            (copy / "pagewright" / "llm" / "__pycache__").mkdir(parents=True)
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)


@pytest.mark.parametrize("name", ["embedding_inputs", "embedding_inputs_older", "formula_merge", "page_merge"])
def test_empty_texts(spark, small, tmp_path, name):
    """Empty, blank and null values give what SQL's concat makes of them."""
    text = "One line here\n\nab and more\nab c"
    rows = [(0, text, "en", "src1", len(text)), (1, "", "en", "src1", 0), (2, "", "de", "src2", 0), (3, " \n", "fr", "src1", 2), (4, None, "en", "src1", None), (5, text, None, "src3", 3), (6, text, "", "src3", 3), (7, text, "en", "", 3), (8, text, "en", None, 3), (9, "", "", "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES[name](spark, str(tmp_path))
    own = duckdb.connect()
    own.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    found = own.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert {r["doc_id"]: [r[c] for c in names] for r in df.collect()} == {r[names.index("doc_id")]: list(r) for r in found.fetchall()}
