"""Operators 5 and 6 against brute force, on awkward rows and on a fixture."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.llm import components, minhash, substring_dedup


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in parent}


def check_near(rows, got):
    labels = brute_components([(r["doc_id"], r["text"]) for r in rows])
    expected = Counter((r["doc_id"], len(shingles(r["text"])), labels.get(r["doc_id"])) for r in rows)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in got)


def test_near_awkward(docs, no_docs):
    check_near(docs.collect(), minhash.near_duplicates(docs).collect())
    assert minhash.near_duplicates(no_docs).collect() == []
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in brute_components([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if i == c} | {None}


def test_near_fixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    check_near(docs.collect(), minhash.near_duplicates(docs).collect())


def test_links_that_no_star_has(spark):
    """Texts along a chain: neighbours are links, the ends are not, and all share buckets with the least one."""
    w = [f"w{k}" for k in range(240)]
    rows = [(n, " ".join(w[:160] if n == 0 else w[4 * n : 160 + 4 * n])) for n in range(18)]
    rows += [(100 + n, " ".join([*w[:130], *(f"z{n}_{k}" for k in range(30))])) for n in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (minhash.MinHashParams(), minhash.MinHashParams(hot=3, broadcast_rows=0)):
        check_near(docs.collect(), minhash.near_duplicates(docs, p).collect())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    import random

    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {x["node"]: x["label"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = list(range(200))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {n: find(n) for e in edges if e[0] != e[1] for n in e}


def brute_covered(data, width):
    """Of each sequence, which places lie in a window of width that occurs twice or more."""
    key = lambda d, i: hash(tuple(d[i : i + width]) if isinstance(d, list) else d[i : i + width])  # noqa: E731  64 bits
    seen = Counter(key(d, i) for d in data for i in range(len(d) - width + 1))
    for d in data:
        gone, until = bytearray(len(d)), 0
        for i in range(len(d) - width + 1):
            if seen[key(d, i)] > 1:
                gone[max(i, until) : i + width] = b"\1" * (i + width - max(i, until))
                until = i + width
        yield gone


def brute_repeats(texts, width=400):
    data = [(t or "").encode() for t in texts]
    out = []
    for d, gone in zip(data, brute_covered(data, width), strict=True):
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats_awkward(docs, no_docs, limit):
    p = substring_dedup.SubstringParams(group_limit=limit, shard_bytes=1 << 12)
    some = docs
    rows = some.select("doc_id", "text").collect()
    expected = Counter((r["doc_id"], *e) for r, e in zip(rows, brute_repeats([r["text"] for r in rows]), strict=True))
    got = substring_dedup.substring_digests(some, p).collect()
    assert Counter(tuple(r) for r in got) == expected
    assert sum(r["n_removed"] for r in got) > 0
    assert substring_dedup.substring_digests(no_docs, p).collect() == []
    cut = substring_dedup.remove_repeats(some, p)
    assert cut.columns == docs.columns
    assert cut.where("n_chars <> length(text)").count() == 0


@pytest.mark.parametrize("limit", [4096, 2])
def test_repeats_of_a_hot_passage(spark, limit):
    """One passage in many contexts, with chance agreement beyond its ends."""
    import random

    r = random.Random(3)
    letters = lambda n: "".join(r.choice("ab ") for _ in range(n))
    passage = "".join(r.choice("abcdefgh ") for _ in range(520))
    rows = [(n, letters(r.randrange(200)) + passage[r.randrange(3) * 60 :] + letters(r.randrange(200))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {i: e for (i, _), e in zip(rows, brute_repeats([t for _, t in rows]), strict=True)}
    got = substring_dedup.substring_digests(docs, substring_dedup.SubstringParams(group_limit=limit, shard_bytes=1 << 11)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == expected


def test_repeats_fixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    expected = {r["doc_id"]: e for r, e in zip(rows, brute_repeats([r["text"] for r in rows]), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.substring_digests(docs).collect()} == expected


def brute_passages(texts, width=50):
    """Texts without the words of passages that occur twice; a word goes with the white space behind it."""
    found = [list(re.finditer(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    out = []
    for t, m, gone in zip(texts, found, brute_covered([[x[0] for x in m] for m in found], width), strict=True):
        if not any(gone):
            out.append(t)
            continue
        parts = [t[: m[0].start()]]
        for k, x in enumerate(m):
            if not gone[k]:
                parts.append(t[x.start() : m[k + 1].start() if k + 1 < len(m) else len(t)])
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_passages_awkward(docs, no_docs, limit):
    from dataclasses import replace

    p = replace(substring_dedup.PASSAGES, group_limit=limit, shard_bytes=1 << 12)
    rows = docs.collect()
    cut = brute_passages([r["text"] or "" for r in rows])
    got = substring_dedup.remove_repeats(docs, p)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in got.collect()) == Counter((r["doc_id"], t) for r, t in zip(rows, cut, strict=True))
    assert sum(t != (r["text"] or "") for r, t in zip(rows, cut, strict=True)) >= 8
    assert substring_dedup.remove_repeats(no_docs, p).collect() == []


@pytest.mark.parametrize("limit", [4096, 3])
def test_passages_under_400_bytes(spark, limit):
    """Short words, other line breaks, runs of one word, a passage of 49 words that stays."""
    import random
    from dataclasses import replace

    r = random.Random(8)
    words = lambda n: [r.choice("abcdefgh") * r.randrange(1, 4) for _ in range(n)]
    passage, short = words(51), words(49)
    rows = [(n, " ".join(words(r.randrange(60))) + "\n" + r.choice(" \n").join(passage) + " \t" + " ".join(words(r.randrange(60)))) for n in range(30)]
    rows += [(100 + n, " ".join([*words(70), f"before{n}", *short, f"after{n}", *words(70)])) for n in range(3)] + [(200, "the " * 130), (201, "x " + "the " * 49)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in substring_dedup.remove_repeats(docs, replace(substring_dedup.PASSAGES, group_limit=limit)).collect()}
    assert got == {i: t for (i, _), t in zip(rows, brute_passages([t for _, t in rows]), strict=True)}
    assert all(" ".join(passage) not in " ".join(got[n].split()) for n in range(30)) and all(got[i] == t for i, t in rows[30:33])


def test_passages_fixture(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs, substring_dedup.PASSAGES).collect()}
    assert got == {r["doc_id"]: t for r, t in zip(rows, brute_passages([r["text"] for r in rows]), strict=True)}


def test_utf8_cut(spark):
    shared = "é" * 250
    docs = spark.createDataFrame([(1, "x" + shared + "ñ"), (2, "y" + shared + "ó")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(docs).collect()}
    assert all("�" not in t for t in got.values())
    assert F is not None


def test_hot_leader(spark):
    """Many near copies of one text, that of the least id: its pairs are dealt to many tasks."""
    w = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(w))] + [(k, " ".join([*w[:k % 100], f"x{k}", *w[k % 100 + 1 :]])) for k in range(1, 90)] + [(500, "other words are in this text"), (501, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_near(docs.collect(), minhash.near_duplicates(docs, minhash.MinHashParams(hot=4)).collect())
    check_near(docs.collect(), minhash.near_duplicates(docs, minhash.MinHashParams(hot=4, broadcast_rows=0)).collect())
