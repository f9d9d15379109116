"""Model steps behind small protocols, with deterministic offline defaults: embedding, summary, prose splitting, vision."""

from __future__ import annotations

import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIMENSION = 1536


class EmbeddingBackend(Protocol):
    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashingBackend:
    """Feature hashing of words (Weinberger et al. 2009), unit length for every text with a word; needs no model and no network."""

    def __init__(self, dimension: int = DIMENSION):
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension), np.float32)
        for k, t in enumerate(texts):
            hashes = [zlib.crc32(w.encode()) for w in re.findall(r"[a-z0-9]+", t.lower())]
            for h in hashes:
                out[k, h % self.dimension] += 1 if h >> 31 else -1
            if hashes and not out[k].any():  # words that cancel each other out count without signs
                for h in hashes:
                    out[k, h % self.dimension] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column, backend: EmbeddingBackend | None = None) -> Column:
    """Embedding of a text; blank texts become zero vectors without a call to the backend."""
    backend = backend or HashingBackend()

    @F.arrow_udf("array<float>")
    def run(c: pa.Array) -> pa.Array:
        texts = c.to_pylist()
        out = np.zeros((len(texts), backend.dimension), np.float32)
        use = [k for k, t in enumerate(texts) if t and t.strip()]
        if use:
            out[use] = backend.embed([texts[k] for k in use])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * backend.dimension, pa.int32()), pa.array(out.ravel()))

    return run(text)


def vector_of(text: Column, dimension: int) -> Column:
    """A vector that is written as a JSON list; null if it isn't one. A vector of another length stops the job."""
    return checked_dimension(F.from_json(text, "array<float>"), dimension)


def checked_dimension(vector: Column, dimension: int) -> Column:
    """The vector; a vector of another length stops the job."""
    return F.when(vector.isNull() | (F.size(vector) == dimension), vector).otherwise(F.raise_error(F.concat(F.lit(f"vector of another dimension than {dimension}: "), F.size(vector).cast("string"))))


#: A summary backend maps (topic, body) to a rich summary, as a JSON text; None leaves the chunk as it is.
SummaryBackend = Callable[[str, str], str | None]


def no_summary(topic: str, body: str) -> str | None:
    return None


def leading_summary(topic: str, body: str) -> str | None:
    """An offline summary: the first sentence is the headline, frequent long words are the keywords."""
    import json
    from collections import Counter

    if not body.strip():
        return None
    words = Counter(w for w in re.findall(r"[a-z][a-z\-']{5,}", body.lower()))
    best = sorted(words, key=lambda w: (-words[w], w))[:5]
    return json.dumps({"section_number": "", "headline": re.split(r"(?<=[.!?])\s", body.strip())[0][:200], "definitions": [], "key_concepts": best[:3], "formulas": [], "worked_examples": [], "exam_keywords": best})


@dataclass(frozen=True)
class CallLimit:
    """at_once bounds the calls to a model in flight, over all tasks together. A call that fails is made again, attempts times in all, after a pause (in seconds) that doubles each
    time up to longest."""

    at_once: int = 5
    attempts: int = 3
    pause: float = 0.5
    longest: float = 30.0

    def dealt(self, parallelism: int) -> tuple[int | None, int]:
        """The partitions that rows are dealt to so that no more tasks run than calls may be in flight (None: any number), and the calls of a task."""
        return (self.at_once, 1) if self.at_once < parallelism else (None, self.at_once // parallelism)


def bounded(rows: DataFrame, limit: CallLimit) -> DataFrame:
    """rows, in as few partitions as limit asks for."""
    partitions, _ = limit.dealt(rows.sparkSession.sparkContext.defaultParallelism)
    return rows if partitions is None else rows.repartition(partitions)


def ordered_calls(call: Callable, items: Iterator, width: int, limit: CallLimit = CallLimit()) -> Iterator[tuple[object, str | None]]:
    """The result and the error (one of them None) of call for each of items, in order; width calls at most are in flight, and no item is taken before one of them may start."""

    def tried(item) -> tuple[object, str | None]:
        for attempt in range(1, limit.attempts + 1):
            try:
                return call(item), None
            except Exception as e:  # noqa: BLE001  a failed call is reported, not fatal
                if attempt == limit.attempts:
                    return None, str(e) or type(e).__name__
                time.sleep(min(limit.longest, limit.pause * 2 ** (attempt - 1)))
        return None, "no attempt was allowed"

    if width == 1:
        yield from map(tried, items)
        return
    with ThreadPoolExecutor(width) as pool:
        flying: deque = deque()
        for item in items:
            flying.append(pool.submit(tried, item))
            if len(flying) == width:
                yield flying.popleft().result()
        while flying:
            yield flying.popleft().result()


def summaries(topic: Column, text: Column, backend: SummaryBackend = no_summary, max_body_chars: int = 12_000, width: int = 1, limit: CallLimit = CallLimit()) -> Column:
    """JSON of the rich summary, or null: blank texts aren't sent, and a backend that fails leaves the chunk as it is. A task makes width calls at a time."""
    if backend is no_summary:
        return F.lit(None).cast("string")

    @F.arrow_udf("string")
    def run(t: pa.Array, b: pa.Array) -> pa.Array:
        sent = [(topic_ or "", body) for topic_, body in zip(t.to_pylist(), b.to_pylist(), strict=True)]
        call = lambda x: backend(*x) if x[1] and x[1].strip() else None
        return pa.array([found for found, _ in ordered_calls(call, iter(sent), width, limit)], pa.string())

    return run.asNondeterministic()(topic, F.left(text, F.lit(max_body_chars)))  # a call for each row, never twice


#: A split backend maps (prose, title) to spans (start, end, role, title, keywords); an empty list means none.
SplitBackend = Callable[[str, str], list[tuple[int, int, str, str, list[str]]]]


def no_split(prose: str, title: str) -> list[tuple[int, int, str, str, list[str]]]:
    return []


#: A vision backend maps the bytes of a page image to its record as a JSON text.
VisionBackend = Callable[[bytes], str]


def extract_pages(images: DataFrame, backend: VisionBackend, concurrency: int = 5, limit: CallLimit | None = None) -> DataFrame:
    """images: document_id, page_number, content. Record (JSON) and error of each page, in as many tasks and calls as limit (or concurrency, with its other settings) allows; a
    page that fails in all attempts has its last error."""
    limit = limit or CallLimit(concurrency)
    _, width = limit.dealt(images.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: deque = deque()

        def contents() -> Iterator[bytes]:
            for batch in batches:
                for document, number, content in zip(*batch.columns, strict=True):
                    keys.append((document.as_py(), number.as_py()))
                    yield content.as_py()

        def rows() -> Iterator[tuple]:
            for record, error in ordered_calls(backend, contents(), width, limit):
                yield *keys.popleft(), record, error

        found = rows()
        while some := list(islice(found, 64)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)], ["document_id", "page_number", "record", "error"])

    return bounded(images.select("document_id", F.col("page_number").cast("int").alias("page_number"), "content"), limit).mapInArrow(run, "document_id string, page_number int, record string, error string")
