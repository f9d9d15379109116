from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string"


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    r = random.Random(5)
    words = ["w%d" % k for k in range(400)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage = text(200), text(150)
    near = base.split()
    near[100] = "other"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (7, text(30_000)), (8, text(50) + " " + passage + " " + text(40)), (9, text(20) + "\n" + passage + "\n" + text(60)),
        (10, "short text"), (11, "short  TEXT"), (12, text(120)), (12, None), (13, text(80)), (13, None), (None, text(90)), (None, None), (14, "é" * 500 + text(50)), (15, "è" * 500 + text(50)), (16, "a" * 3000),
    ]
    rows.append((17, rows[11][1]))
    out = [(i, t, "en" if k % 3 else None, ["a", "b", None][k % 3], None if t is None else len(t), "x", "y") for k, (i, t) in enumerate(rows)]
    return out + [out[7], out[7]]


@pytest.fixture(scope="session")
def docs(spark, awkward):
    return spark.createDataFrame(awkward, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
