"""Calls to models: bounded, in order, made again, failures kept as rows."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from pagewright.functions.backends import CallLimit, extract_pages, ordered_calls
from pagewright.operators.chunks import summarised


class Model:
    """Counts the calls in flight; fails for odd items, the first time or always."""

    def __init__(self, always: bool = False):
        self.lock, self.now, self.most, self.seen, self.always = threading.Lock(), 0, 0, {}, always

    def __call__(self, item):
        with self.lock:
            self.now += 1
            self.most = max(self.most, self.now)
            self.seen[item] = self.seen.get(item, 0) + 1
        time.sleep(0.002 * (item % 4))
        with self.lock:
            self.now -= 1
        if item % 2 and (self.always or self.seen[item] == 1):
            raise ValueError(f"no {item}")
        return item * 10


@pytest.mark.parametrize("width", [1, 3, 8])
def test_in_order_and_bounded(width):
    m, limit = Model(), CallLimit(attempts=2, pause=0.001)
    taken = []
    items = (taken.append(k) or k for k in range(60))
    got = ordered_calls(m, items, width, limit)
    first = [next(got) for _ in range(5)]
    assert len(taken) <= 5 + width
    assert [*first, *got] == [(10 * k, None) for k in range(60)]
    assert m.most <= width and (width == 1 or m.most > 1) and m.seen == {k: 1 + k % 2 for k in range(60)}
    m = Model(always=True)
    assert list(ordered_calls(m, iter(range(4)), width, limit)) == [(0, None), (None, "no 1"), (20, None), (None, "no 3")]
    assert m.seen == {0: 1, 1: 2, 2: 1, 3: 2}


def test_dealt():
    assert CallLimit(5).dealt(8) == (5, 1) and CallLimit(20).dealt(8) == (None, 2) and CallLimit(8).dealt(8) == (None, 1)


def intervals_of(folder):
    return [tuple(map(float, p.read_text().split())) for p in folder.iterdir()]


def most_at_once(spans):
    marks = sorted([(a, 1) for a, _ in spans] + [(b, -1) for _, b in spans])
    now = most = 0
    for _, step in marks:
        now += step
        most = max(most, now)
    return most


@pytest.mark.parametrize("at_once", [2, 9])
def test_pages_over_tasks(spark, tmp_path, at_once):
    """Over all Python workers together no more calls than allowed; every page has a record or an error."""
    where = str(tmp_path)

    def backend(content: bytes) -> str:
        import time
        import uuid

        began = time.time()
        time.sleep(0.02)
        with open(f"{where}/{uuid.uuid4()}", "w") as f:
            f.write(f"{began} {time.time()}")
        if content.endswith(b"7"):
            raise ValueError("unreadable")
        return content.decode()

    images = spark.range(60).select(F.lit("d").alias("document_id"), F.col("id").alias("page_number"), F.col("id").cast("string").cast("binary").alias("content")).repartition(6)
    got = extract_pages(images, backend, limit=CallLimit(at_once, attempts=2, pause=0.001)).collect()
    assert {(r["page_number"], r["record"], r["error"]) for r in got} == {(k, None, "unreadable") if k % 10 == 7 else (k, str(k), None) for k in range(60)}
    spans = intervals_of(tmp_path)
    assert len(spans) == 66 and most_at_once(spans) <= at_once


def test_summaries_over_tasks(spark, tmp_path):
    where = str(tmp_path)

    def backend(topic: str, body: str) -> str | None:
        import json
        import time
        import uuid

        began = time.time()
        time.sleep(0.02)
        with open(f"{where}/{uuid.uuid4()}", "w") as f:
            f.write(f"{began} {time.time()}")
        if "3" in topic:
            raise ValueError("down")
        return json.dumps({"headline": f"about {topic}", "exam_keywords": [topic]})

    none = F.array().cast("array<struct<name:string,latex:string,variables:array<struct<symbol:string,meaning:string>>,context:string,describes:string>>")
    chunks = spark.range(40).select(F.col("id").cast("string").alias("topic"), F.lit("text").alias("search_text"), none.alias("formulas"), F.lit("").alias("section_id"), F.lit("old").alias("topic_scope")).repartition(8)
    got = {r["topic"]: r["topic_scope"] for r in summarised(chunks, backend, limit=CallLimit(2, attempts=1)).collect()}
    assert got == {str(k): "old" if "3" in str(k) else f"about {k}" for k in range(40)}
    spans = intervals_of(tmp_path)
    assert len(spans) == 40 and most_at_once(spans) <= 2


def test_words_that_cancel_out_have_a_vector():
    """Two words of one place and opposite signs once gave the zero vector."""
    import zlib

    import numpy as np

    from pagewright.functions.backends import HashingBackend

    by: dict = {}
    for i in range(1000):
        h = zlib.crc32(f"w{i}".encode())
        by.setdefault(h % 64, {})[h >> 31] = f"w{i}"
    pair = " ".join(next(v for v in by.values() if len(v) == 2).values())
    found = HashingBackend(64).embed([pair, pair + " " + pair, "plain", " ,"])
    assert np.allclose(np.linalg.norm(found, axis=1), [1, 1, 1, 0])
