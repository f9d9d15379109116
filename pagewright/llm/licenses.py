"""Operator 4: licence scans by a trained paragraph classifier.

Paragraphs (lines; long ones in pieces of ``piece_words`` words) are bags of hashed word uni- and bigrams. Multinomial
logistic regression, trained here, tells licence families from each other and from everything else; its temperature
and the bar that a family must pass are calibrated on rows that training hasn't seen, so that what is unlike all
families is ``unknown``. A prediction counts only if the paragraph also compares with a template of its family.

Notices that are wrapped, or lie across two pieces of a long line, are found in blocks: neighbouring lines up to one without words. A
block is classified and compared in overlapping pieces of a quarter, a half and all of ``piece_words``; by their strides, templates of
up to 48 words are whole in one of 64. Such a piece counts once for each notice, and only where no line, and no piece that compares
better, has given its family, or a sister of it (CC, GPL), for these words. n_paragraphs counts lines and pieces of lines. A prediction is
compared with its own piece, never with the rest of a long line. A notice of under four words amid the words of a longer line may be missed: among 16
words, the shortest piece of a line, so few don't outweigh the others. On a line of its own it is found.

Training rows are variants of the templates below (words dropped, replaced, cut off, put in context) and, for the unknown
class, at most ``background`` paragraphs of the corpus that compare with no template: one of each of some documents, all chosen
by hashes of the id, from the whole text.

Defined results: a null or empty text has no paragraphs and no licence; without background rows the unknown class is
trained on shuffled words; ties go to the family that is first in order; repeated rows are judged alike. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, table
from ._vec import U, mix, run_hashes, slices, word_bounds

#: Usual notices of the licence families.
TEMPLATES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
        "SPDX-License-Identifier: MIT",
        "This project is licensed under the terms of the MIT license",
    ),
    "bsd": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
        "This work is licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 3",
        "SPDX-License-Identifier: LGPL-3.0-only",
    ),
    "agpl": ("This program is licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License", "Licensed under CC BY-ND 4.0"),
    "public-domain": ("This work is released into the public domain under CC0 1.0 Universal", "This is free and unencumbered software released into the public domain"),
    "all-rights-reserved": ("All rights reserved", "Copyright 2020 Example Corporation. All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher"),
}
FAMILIES = [*TEMPLATES, "unknown"]
#: Text that talks of licences without giving one.
NEAR_MISSES = (
    "She got her driving license last year and has permission to use the car",
    "The general public was not granted free access to the source of the river",
    "A new version of the software was released under pressure from the community",
    "The commission reserved judgement on all rights of way across the land",
    "He is a creative person and the work is common to all",
    "You may obtain a copy of the report at the library",
    "The terms of the agreement were published by the foundation",
    "Attribution of the painting to the master is uncertain",
)


@dataclass(frozen=True)
class LicenseParams:
    """features: buckets of word grams. variants: training rows for each template. background bounds the paragraphs of the corpus that
    the unknown class is trained on. piece_words: longer lines are paragraphs in pieces. false_positives: the share of rows of the unknown
    class that may pass the bar of a family. similarity: the share of a template's word pairs that confirms it."""

    features: int = 4096
    variants: int = 24
    background: int = 1500
    piece_words: int = 64
    false_positives: float = 0.002
    similarity: float = 0.5
    epochs: int = 120


_LETTERS = bytes(c if chr(c).isalnum() or c >= 128 or c == 0x0A else 0x20 for c in range(256)).lower()


def _clean(text: str) -> bytes:
    return text.encode().translate(_LETTERS)


def _grams(cleaned: list[bytes], p: LicenseParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]:
    """Of all texts: buckets of uni- and bigrams in turn (-1: none), first word of each paragraph, its text, its line; for blocks: the bytes, each
    word's start, end, line among all and text, and the bigram buckets over line ends."""
    buf = np.frombuffer(b"\n".join(cleaned) + b"\n", np.uint8)
    starts, ends = word_bounds(buf)
    h = run_hashes(buf, starts, ends)
    at = np.cumsum([0, *(len(c) + 1 for c in cleaned)])
    line = np.cumsum(buf == 0x0A)
    own = line[starts]
    new = np.ones(len(starts), bool)
    new[1:] = own[1:] != own[:-1]
    place = np.arange(len(starts)) - np.maximum.accumulate(np.where(new, np.arange(len(starts)), 0))
    new |= place % p.piece_words == 0
    first = np.flatnonzero(new)
    bucket = np.full((len(starts), 2), -1, np.int64)
    bucket[:, 0] = (h % U(p.features)).astype(np.int64)
    two = np.full(len(starts), -1, np.int64)
    if len(h) > 1:
        two[:-1] = (mix(h[:-1] * U(3) + h[1:]) % U(p.features)).astype(np.int64)
        bucket[:-1, 1] = np.where(new[1:], -1, two[:-1])
    text = np.searchsorted(at, starts[first], "right") - 1
    words = (buf, starts, ends, own, np.searchsorted(at, starts, "right") - 1, two)
    return bucket, first, text, own[first] - np.searchsorted(np.flatnonzero(buf == 0x0A), at[text]), words


def _block_pieces(own: np.ndarray, text: np.ndarray, p: LicenseParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words and ends of the pieces of blocks that lines don't show whole; the words that end a block."""
    new = np.ones(len(own), bool)
    new[1:] = (text[1:] != text[:-1]) | (own[1:] > own[:-1] + 1)
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(own)))
    last = head + size - 1
    more = (own[last] != own[head]) | (size > p.piece_words)
    begin, end = np.repeat(head, size), np.repeat(head + size, size)
    k = np.flatnonzero(np.repeat(more, size))
    out = []
    for part, steps in ((4, 2), (2, 4), (1, 4)):
        width = max(2, p.piece_words // part)
        stride = max(1, width // steps)
        at = k - begin[k]
        a = k[(at % stride == 0) & ((at == 0) | (k - stride + width < end[k]))]
        out.append((a, np.minimum(a + width, end[a])))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out]), last


def _stem(family: str) -> str:
    return family.split("-")[0][-3:]


def _matrix(texts: list[str], p: LicenseParams) -> np.ndarray:
    """One row of gram counts, scaled by the root of their number, for each text taken as one paragraph."""
    x = np.zeros((len(texts), p.features), np.float32)
    for k, t in enumerate(texts):
        bucket, *_ = _grams([_clean(t).replace(b"\n", b" ")], p)
        b = bucket[bucket >= 0]
        np.add.at(x[k], b, 1)
        x[k] /= max(1.0, len(b)) ** 0.5
    return x


def similarity(paragraph: str, template: str) -> float:
    """Share of the template's words (as a sequence of pairs, or words if there are under three) that the paragraph has."""
    a, b = _clean(paragraph).split(), _clean(template).split()
    if len(b) < 3:
        return len(set(a) & set(b)) / max(1, len(set(b)))
    pairs = lambda w: set(zip(w, w[1:]))
    return len(pairs(a) & pairs(b)) / max(1, len(pairs(b)))


def best_similarity(paragraph: str, family: str) -> float:
    return max(similarity(paragraph, t) for t in TEMPLATES[family])


@dataclass
class LicenseModel:
    weights: np.ndarray  # features + 1 x families; the last row is the bias
    temperature: float
    bar: float

    def probabilities(self, raw: np.ndarray) -> np.ndarray:
        z = raw / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _variants(words: list[str], other: list[str], r: np.random.Generator) -> str:
    w = list(words)
    if len(w) > 8 and r.random() < 0.4:
        n = int(len(w) * r.uniform(0.6, 1))
        s = int(r.integers(0, len(w) - n + 1))
        w = w[s : s + n]
    if len(w) > 5:
        w = [x if r.random() > 0.05 else str(r.choice(other)) for x in w if r.random() > 0.05]
    if r.random() < 0.4:
        w = [*map(str, r.choice(other, int(r.integers(1, 8)))), *w]
    if r.random() < 0.4:
        w = [*w, *map(str, r.choice(other, int(r.integers(1, 8))))]
    return " ".join(w)


def fit(background: list[str], p: LicenseParams = LicenseParams()) -> LicenseModel:
    r = np.random.default_rng(7)
    background = [b for b in background if max(best_similarity(b, f) for f in TEMPLATES) < 0.3]
    other = sorted({w for b in background[:300] for w in b.split()})[:5000] or "the of and a to in is on by it or be at as an we us if no do".split()
    texts, y = [], []
    for k, family in enumerate(TEMPLATES):
        for t in TEMPLATES[family]:
            for n in range(p.variants):
                texts.append(t if n == 0 else _variants(t.split(), other, r))
                y.append(k)
    vocabulary = sorted({w for f in TEMPLATES.values() for t in f for w in t.split()})
    unknown = [*background, *NEAR_MISSES * 4, *(" ".join(map(str, r.choice(vocabulary + other[:200], int(r.integers(3, 25))))) for _ in range(300))]
    texts += unknown
    y += [len(TEMPLATES)] * len(unknown)
    x = np.hstack([_matrix(texts, p), np.ones((len(texts), 1), np.float32)])
    y = np.array(y)
    held = r.random(len(y)) < 0.25
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    share = 1 / np.maximum(1, np.bincount(y[~held], minlength=len(FAMILIES)))
    weight = (share[y] * (~held)).astype(np.float32)[:, None]
    weight /= weight.sum()
    w = np.zeros((x.shape[1], len(FAMILIES)), np.float32)
    speed = np.zeros_like(w)
    xt, xs, ts, ws = np.ascontiguousarray(x[~held].T), x[~held], target[~held], weight[~held]
    for _ in range(p.epochs):
        z = xs @ w
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        speed = 0.9 * speed - 8.0 * (xt @ ((z - ts) * ws) + 1e-5 * w)
        w += speed
    model = LicenseModel(w, 1.0, 0.5)
    raw = x[held] @ w

    def loss(t: float) -> float:
        model.temperature = t
        return -float(np.log(np.maximum(model.probabilities(raw)[np.arange(len(raw)), y[held]], 1e-9)).mean())

    model.temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    probability = model.probabilities(raw)[y[held] == len(TEMPLATES), :-1].max(axis=1)
    model.bar = float(max(0.5, np.quantile(probability, 1 - p.false_positives))) if len(probability) else 0.5
    model.bar = min(model.bar, 0.9)
    return model


def _scan(batches: Iterator[pa.RecordBatch], model: LicenseModel, p: LicenseParams) -> Iterator[pa.RecordBatch]:
    entry = pa.struct([("family", pa.string()), ("line", pa.int32()), ("probability", pa.float64()), ("similarity", pa.float64())])
    table_ = np.vstack([model.weights[:-1], np.zeros((1, len(FAMILIES)), np.float32)])  # the row of bucket -1
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        counts = np.zeros(len(texts), np.int64)
        found: list[list[dict]] = [[] for _ in texts]
        for lo, hi in slices([len(t) for t in texts], 1 << 18):
            bucket, first, text, line, (buf, starts, ends, own, of, two) = _grams([_clean(t) for t in texts[lo:hi]], p)
            if not len(first):
                continue
            n = np.add.reduceat((bucket >= 0).sum(axis=1), first)
            raw = np.add.reduceat(table_[bucket[:, 0]] + table_[bucket[:, 1]], first, axis=0) / np.sqrt(n)[:, None] + model.weights[-1]
            counts[lo:hi] = np.bincount(text, minlength=hi - lo)
            probability = model.probabilities(raw)
            top = probability[:, :-1].argmax(axis=1)
            value = probability[np.arange(len(top)), top]
            compared: dict[tuple[bytes, str], float] = {}  # notices repeat

            def compare(a: int, b: int, family: str) -> float:
                """The similarity of words a to b with the family's templates."""
                key = buf[starts[a] : ends[b - 1]].tobytes(), family
                if key not in compared:
                    compared[key] = best_similarity(key[0].decode(errors="replace"), family)
                return compared[key]

            # what was found, by text and place: a span is piece_words long at most, so those that meet it lie in its stretch or one next to it
            spans: dict[tuple[int, int], list[tuple[int, int, str, float]]] = {}
            put = lambda t, span: spans.setdefault((t, span[0] // p.piece_words), []).append(span)
            near = lambda t, at, size: [x for k in range(at // p.piece_words - 1, (at + size) // p.piece_words + 1) for x in spans.get((t, k), ()) if x[0] < at + size and at < x[1]]
            for k in np.flatnonzero(value >= model.bar).tolist():
                family, t = FAMILIES[top[k]], lo + int(text[k])
                until = int(first[k + 1]) if k + 1 < len(first) else len(starts)
                sim = compare(int(first[k]), until, family)
                if sim >= p.similarity:
                    found[t].append({"family": family, "line": int(line[k]), "probability": float(value[k]), "similarity": sim})
                    put(t, (int(first[k]), until, family, sim))
            a, b, last = _block_pieces(own, of, p)
            if not len(a):
                continue
            two[last] = -1
            total = np.zeros((len(two) + 1, len(FAMILIES)))
            np.cumsum(table_[bucket[:, 0]] + table_[two], axis=0, out=total[1:])
            raw = (total[b] - total[a] - table_[two[b - 1]]) / np.sqrt(2 * (b - a) - 1)[:, None] + model.weights[-1]
            probability = model.probabilities(raw)
            top = probability[:, :-1].argmax(axis=1)
            value = probability[np.arange(len(top)), top]
            more = []
            for k in np.flatnonzero(value >= model.bar).tolist():
                family = FAMILIES[top[k]]
                sim = compare(int(a[k]), int(b[k]), family)
                if sim >= p.similarity:
                    more.append((-sim, int(b[k] - a[k]), -float(value[k]), int(a[k]), family))
            for sim, size, minus, at, family in sorted(more):
                t = lo + int(of[at])
                met = [x for x in near(t, at, size) if _stem(x[2]) == _stem(family)]
                if not any(f == family or s >= -sim for _, _, f, s in met):
                    put(t, (at, at + size, family, -sim))
                    number = int(own[at] - own[np.searchsorted(of, of[at])]) + int(line[np.searchsorted(text, of[at])])
                    found[t].append({"family": family, "line": number, "probability": -minus, "similarity": -sim})
        best = [min(f, key=lambda e: (-e["similarity"], -e["probability"], FAMILIES.index(e["family"])))["family"] if f else None for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(best, pa.string()), pa.array(found, pa.list_(entry))], ["doc_id", "n_paragraphs", "license", "found"])


def train(docs: DataFrame, p: LicenseParams = LicenseParams()) -> LicenseModel:
    """docs: doc_id, text. The same documents, in any order, give the same model."""
    n = docs.where("text is not null").count()
    share = int((1 << 20) * min(1.0, 1.2 * p.background / max(1, n))) + 1
    by = lambda seed: F.xxhash64("doc_id", F.lit(seed))
    one = lambda parts, seed: F.get(parts, F.pmod(by(seed), F.greatest(F.size(parts), F.lit(1))).cast("int"))
    rows = docs.where((F.pmod(by(5), F.lit(1 << 20)) < share) & F.col("text").isNotNull())
    lines = F.filter(F.split("text", "\n"), lambda x: F.regexp_replace(x, WHITE, "") != "")
    words = F.array_remove(F.split(one(lines, 6), WHITE), "")
    rows = rows.select("doc_id", words.alias("w")).where(F.size("w") > 0)
    piece = F.pmod(by(7), F.ceil(F.size("w") / p.piece_words)).cast("int")
    rows = rows.select(by(8).alias("h"), F.array_join(F.slice("w", piece * p.piece_words + 1, F.lit(p.piece_words)), " ").alias("t"))
    return fit([r["t"] for r in rows.orderBy("h", "t").limit(p.background).collect()], p)


def scan_licenses(docs: DataFrame, model: LicenseModel, p: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_paragraphs, license (the best confirmed family or null) and found, all confirmed paragraphs, of each row."""
    kind = "doc_id long, n_paragraphs long, license string, found array<struct<family:string,line:int,probability:double,similarity:double>>"
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, model=model, p=p), kind)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_licenses(docs, train(docs))
    return found.select("doc_id", "n_paragraphs", "license", F.size("found").cast("long").alias("n_found"), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))).alias("families"))
