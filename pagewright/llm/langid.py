"""Operator 2: language identification with spans of mixed-language text.

Script ranges leave each word the languages that were learned with that script; a word's score for a language is the
log-likelihood of its character trigrams; Viterbi with a switching penalty labels the words, so a passage in another
language becomes a span of its own. A document gets the language of most of its letters.

The model is trained here, on texts and their labels only, from at most ``per_language`` documents of a language
(chosen by a hash of the id). It has ``buckets`` numbers for each language.

Defined results: a null or empty text, or one without letters, is ``und`` with score 0 and no spans; ties go to the
language that is first in code point order; rows without label train nothing; without any training row everything is
``und``. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chars import SCRIPTS, looked_up, points, tables
from ._common import crc_mod, table
from ._vec import slices


@dataclass(frozen=True)
class LangParams:
    """per_language bounds the documents that a language is learned from, buckets the numbers that it has. switch_penalty is what another
    language than the word before's costs, in log-likelihood. words_at_once bounds the words that Viterbi labels together (memory
    only: documents aren't cut, the result is the same)."""

    per_language: int = 3000
    buckets: int = 1 << 16
    smoothing: float = 0.5
    switch_penalty: float = 12.0
    words_at_once: int = 4_000_000


@dataclass
class LangModel:
    languages: list[str] = field(default_factory=list)
    scores: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # buckets x languages
    allowed: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), bool))  # scripts x languages


@dataclass
class _Words:
    bucket: np.ndarray  # of each letter
    first: np.ndarray  # number of the first letter of each word
    letters: np.ndarray  # of each word
    script: np.ndarray
    start: np.ndarray  # code point offsets in the slice
    end: np.ndarray


def _words(cps: np.ndarray, buckets: int) -> _Words:
    letter, lower, script = tables()
    is_letter = looked_up(letter, cps, True)
    at = np.flatnonzero(is_letter)
    low = np.where(is_letter, looked_up(lower, cps, 0), 0).astype(np.uint32)
    ring = np.concatenate([[0], low, [0]]).astype(np.uint32)
    mixed = (ring[at] * np.uint32(0x9E3779B1) ^ ring[at + 1] * np.uint32(0x85EBCA77)) * np.uint32(0x27D4EB2F) + ring[at + 2] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(8)) % np.uint32(buckets)
    head = np.flatnonzero(np.diff(at, prepend=-2) > 1) if len(at) else at
    start = at[head]
    letters = np.diff(np.append(head, len(at)))
    return _Words(bucket, head, letters, looked_up(script, cps[start], 0), start, start + letters)


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _counts(batches: Iterator[pa.RecordBatch], languages: list[str], params: LangParams) -> Iterator[pa.RecordBatch]:
    """lang, text -> (language number, bucket or -1 - script, count), summed over the batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
        grams = np.zeros((len(languages), params.buckets), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        for k, own in enumerate(languages):
            mine = [t for t, g in zip(texts, langs, strict=True) if g == own]
            for lo, hi in slices([len(t) for t in mine]):
                w = _words(points(mine[lo:hi])[0], params.buckets)
                grams[k] += np.bincount(w.bucket, minlength=params.buckets)
                scripts[k] += np.bincount(w.script, minlength=len(SCRIPTS))
        a, b = np.nonzero(grams)
        c, d = np.nonzero(scripts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(a, c), pa.int32()), pa.array(np.append(b, -1 - d), pa.int32()), pa.array(np.append(grams[a, b], scripts[c, d]))], ["l", "bucket", "n"])


def train(docs: DataFrame, params: LangParams = LangParams()) -> LangModel:
    """docs: doc_id, text, lang; all rows with text and lang may be learned from."""
    known = docs.where("text is not null and lang is not null")
    sizes = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not sizes:
        return LangModel()
    languages = [g for g, _ in sizes]
    share = F.lit(0)
    for g, n in sizes:
        share = F.when(F.col("lang") == g, F.lit(min(1 << 20, int((1 << 20) * params.per_language / n) + 1))).otherwise(share)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share).select("lang", "text")
    parts = some.mapInArrow(partial(_counts, languages=languages, params=params), "l int, bucket int, n long")
    rows = parts.groupBy("l", "bucket").agg(F.sum("n").alias("n")).toPandas()  # buckets + scripts for each language
    grams = np.full((params.buckets, len(languages)), params.smoothing)
    scripts = np.zeros((len(SCRIPTS), len(languages)))
    g = rows[rows["bucket"] >= 0]
    grams[g["bucket"], g["l"]] += g["n"]
    s = rows[rows["bucket"] < 0]
    scripts[-1 - s["bucket"], s["l"]] = s["n"]
    allowed = scripts >= np.maximum(1, 0.002 * scripts.sum(axis=0))
    return LangModel(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word. scores: words x labels; at: where each document's words begin. All documents go
    forward together, one word at a time, the longest first."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    begin, n = at[:-1][order], n[order]
    labels = scores.shape[1]
    value = np.zeros((len(n), labels), np.float64)
    stayed = np.ones((len(scores), labels), bool)
    source = np.zeros(len(scores), np.int32)
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), "left") if longest else []
    for t in range(longest):
        k = int(alive[t])
        row = begin[:k] + t
        v = value[:k]
        if t:
            best = v.max(axis=1, keepdims=True) - penalty
            keep = v >= best
            stayed[row] = keep
            source[row] = v.argmax(axis=1)
            v = np.where(keep, v, best)
        value[:k] = v + scores[row]
    out = np.zeros(len(scores), np.int32)
    state = value.argmax(axis=1)
    for t in range(longest - 1, -1, -1):
        k = int(alive[t])
        row = begin[:k] + t
        s = state[:k]
        out[row] = s
        if t:
            state[:k] = np.where(stayed[row, s], s, source[row])
    return out


def _label(batches: Iterator[pa.RecordBatch], model: LangModel, params: LangParams) -> Iterator[pa.RecordBatch]:
    names = pa.array([*model.languages, "und"])
    span_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])
    wide = len(model.languages)
    if not wide:
        model = LangModel([], np.zeros((params.buckets, 1), np.float32), np.ones((len(SCRIPTS), 1), bool))
    for batch in batches:
        texts = _texts(batch.column(1))
        done = 0
        while done < len(texts) or not texts:
            scores, counts, letters, starts, ends, words = [], [], [], [], [], 0
            begin = done
            for lo, hi in slices([len(t) for t in texts[begin:]]):
                cps, at = points(texts[begin + lo : begin + hi])
                w = _words(cps, params.buckets)
                own = np.add.reduceat(model.scores[w.bucket], w.first, axis=0) if len(w.first) else np.empty((0, model.scores.shape[1]), np.float32)
                ok = model.allowed[w.script]
                own = np.where(ok, own, np.where(ok.any(axis=1, keepdims=True), np.float32(-1e6), np.float32(0)))
                where = np.searchsorted(w.start, at)
                counts.append(np.diff(where))
                base = np.repeat(at[:-1], counts[-1])
                scores.append(own)
                letters.append(w.letters)
                starts.append(w.start - base)
                ends.append(w.end - base)
                words += len(own)
                done = begin + hi
                if words > params.words_at_once:
                    break
            if not texts:
                break
            scores_, letters_, starts_, ends_ = (np.concatenate(x) for x in (scores, letters, starts, ends))
            n = np.concatenate(counts)
            at = np.concatenate([[0], np.cumsum(n)])
            label = viterbi(scores_, at, params.switch_penalty)
            doc = np.repeat(np.arange(len(n)), n)
            mass = np.zeros((len(n), scores_.shape[1]))
            np.add.at(mass, (doc, label), letters_)
            total = mass.sum(axis=1)
            best = np.where((total > 0) & (wide > 0), mass.argmax(axis=1), wide)
            score = np.where((total > 0) & (wide > 0), mass.max(axis=1) / np.maximum(total, 1), 0.0)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(doc)) - 1 if len(doc) else head
            spans = pa.StructArray.from_arrays([pa.array(starts_[head], pa.int32()), pa.array(ends_[tail], pa.int32()), names.take(pa.array(label[head].astype(np.int32)))], fields=list(span_type))
            offsets = np.searchsorted(doc[head], np.arange(len(n) + 1)) if len(doc) else np.zeros(len(n) + 1, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(begin, len(n)), names.take(pa.array(best.astype(np.int32))), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans)], ["doc_id", "lang_pred", "score", "spans"]
            )


def identify(docs: DataFrame, model: LangModel, params: LangParams = LangParams()) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters) and spans of each row."""
    return docs.select("doc_id", "text").mapInArrow(partial(_label, model=model, params=params), "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
