"""Operators 1 and 8 against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from pagewright.llm import mixing, quality_rules

WORD = r"[^\x20\x09-\x0D]+"


def base(text):
    t = text or ""
    w = re.findall(WORD, t)
    n = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    hit = {j for k in range(len(w) - 4) if n[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark, docs, no_docs, small):
    labels = spark.createDataFrame([(1, 1, 0), (10, 0, 0), (12, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.quality_rules(docs, labels).collect()
    assert Counter((r["doc_id"], *(r[c] for c in COUNTS)) for r in got) == Counter((r["doc_id"], *base(r["text"])) for r in docs.collect())
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # too few labels for a rule
    assert quality_rules.quality_rules(no_docs, labels).collect() == []
    whole = spark.read.parquet(f"{small}/documents.parquet")
    got = quality_rules.quality_rules(whole, spark.read.parquet(f"{small}/labels.parquet")).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in got} == {r["doc_id"]: base(r["text"]) for r in whole.collect()}


def test_repeats_in_windows(spark):
    texts = ["a b c d e a b c d e f", "x " * 40, "a b c d", "p q r s t u p q r s t u p q r s t u", "\x0ba\x0cb c\rd e f a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["_q_n_repeat_words"] for r in quality_rules.with_features(docs).collect()}
    assert got == {k: base(t)[4] for k, t in enumerate(texts)}


def test_learned_list(spark):
    """Two kinds of junk, marked by labels, become rules; good documents stay."""
    rows, labels = [], []
    for k in range(600):
        words = [f"w{(k * 31 + j * 7) % 977}x{j}" for j in range(40 + k % 50)]
        kind = k % 4
        if kind == 0:
            words = [w + "***" for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind > 1), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rules = quality_rules.learn(docs, marks)
    assert 1 <= len(rules.rules) <= 4 and "reject if" in str(rules)
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, rules).collect()}
    assert kept == {k for k in range(600) if k % 4 > 1}
    got = quality_rules.quality_rules(docs, marks).collect()
    assert {r["doc_id"] for r in got if r["kept"]} == kept
    half = quality_rules.RuleParams(max_labelled=300)  # a sample of the labels, the same on both ways
    own, test = quality_rules.chosen(marks, half)
    assert 200 < own.count() < 400 and own.count() == docs.where(test).count()
    kept = {r["doc_id"] for r in quality_rules.keep_good(docs, quality_rules.learn(docs, marks, half)).collect()}
    assert kept == {r["doc_id"] for r in quality_rules.quality_rules(docs, marks, half).collect() if r["kept"]}
    assert len(kept ^ {k for k in range(600) if k % 4 > 1}) <= 6


def fill(sizes, weights=(1, 2, 3), most=3):
    total, targets, full = sum(sizes), {}, set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        free = [k for k in range(len(sizes)) if k not in full]
        w = sum(weights[k % 3] for k in free)
        targets = {k: most * sizes[k] if k in full else left * weights[k % 3] / w for k in range(len(sizes))}
        over = [k for k in free if targets[k] > most * sizes[k]]
        if not over:
            return targets
        full |= set(over)


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 1, 1], [5, 500, 7, 90, 3, 2], [10], [0, 50, 60], [1, 1, 1, 1000]])
def test_targets(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes))]
    got = mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()
    expected = fill(sizes)
    for r in got:
        assert r["target"] == pytest.approx(expected[names.index(r["source"])])


def check_mix(rows, got):
    sizes = Counter((r["doc_id"], r["source"], len(re.findall(WORD, r["text"] or ""))) for r in rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == sizes
    by = defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + ([None] if None in by else [])
    expected = fill([sum(r["size"] for r in by[s]) for s in order])
    for k, s in enumerate(order):
        own = by[s]
        assert own[0]["target"] == pytest.approx(expected[k])
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert sum(r["taken"] for r in own) == pytest.approx(expected[k], abs=max(12, 0.01 * expected[k]))


def test_mix(spark, docs, no_docs, small):
    check_mix(docs.collect(), mixing.mix(docs).collect())
    assert mixing.mix(no_docs).collect() == []
    whole = spark.read.parquet(f"{small}/documents.parquet")
    first, second = (mixing.mix(d).collect() for d in (whole, whole.repartition(7)))
    check_mix(whole.collect(), first)
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))


def test_coarse_blocks(spark, small):
    whole = spark.read.parquet(f"{small}/documents.parquet")
    got = mixing.mix(whole, mixing.MixParams(slots=500, shards=8)).collect()
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    own = defaultdict(lambda: [0, 0.0])
    for r in got:
        own[r["source"]][0] += r["taken"]
        own[r["source"]][1] = r["target"]
    assert all(abs(a - b) < 0.15 * b + 400 for a, b in own.values())


def test_small_sources_beside_large_ones(spark):
    """Sources of 1.2, 0.1 and 0.01 blocks beside large ones take their targets to the word."""
    sizes = {"a": 12, "b": 1000, "c": 90_000, "d": 10_000, "e": 120_000, "f": 1200, "g": 100, "h": 7, "i": 500_000}
    rows = []
    for s, n in sizes.items():
        while n:
            k = min(n, 1 + len(rows) * 37 % 700)
            rows.append((len(rows), s, "w " * k))
            n -= k
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), mixing.MixParams(slots=700)).collect()
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and set(target) == set(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
