"""Hashes, suffix arrays and anchors against plain definitions."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagewright.llm import suffix_array as S
from pagewright.llm._vec import shingle_sets, words_of
from pagewright.llm.substring_dedup import SubstringParams, anchors, symbols


def test_words_and_sets():
    texts = [b"The cat sat on the mat", b"", b" \t\n", b"the CAT sat on the mat", b"one two", "é è".encode() * 3]
    words, at = words_of(texts)
    assert np.diff(at).tolist() == [len(t.split()) for t in texts]
    sets = shingle_sets(texts, 5)
    assert [len(s) for s in sets] == [2, 0, 0, 2, 1, 1]
    assert (sets[0] == sets[3]).all()


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(c % 3 + 97 for c in b)))
def test_suffix_array_and_kasai(data):
    text = np.frombuffer(data, np.uint8)
    keys = S.packed(text)
    sa = S.suffix_array(text, 512, keys)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = S.common_prefixes(text, sa, keys)
    for k in range(1, len(sa)):
        a, b = data[sa[k - 1] :], data[sa[k] :]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(min_size=12, max_size=60).map(lambda b: bytes(c % 2 + 97 for c in b)), min_size=1, max_size=8), st.sampled_from([1 << 20, 40]))
def test_repeated_starts(texts, shard):
    width = 10
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    asked = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        mask[: len(t) - width + 1] = True
        asked.append(mask)
    got = S.repeated_starts(arrays, asked, width, shard)
    windows = [t[i : i + width] for t in texts for i in range(len(t) - width + 1)]
    for t, mask in zip(texts, got, strict=True):
        assert mask[: len(t) - width + 1].tolist() == [windows.count(t[i : i + width]) > 1 for i in range(len(t) - width + 1)]


@pytest.mark.parametrize("data", [b"ab" * 400, bytes(np.random.default_rng(1).integers(97, 123, 3000, dtype=np.uint8)), b"x" * 900, b"q" * 399, b"q" * 400])
def test_every_window_has_one_anchor(data):
    p = SubstringParams()
    f, place, lo, hi, _ = anchors(symbols(data, p)[0], p)
    n = max(0, len(data) - p.width + 1)
    covered = np.zeros(n + 1, int)
    for a, b, x in zip(lo, hi, place, strict=True):
        covered[a : b + 1] += 1
        assert all(s <= x <= s + p.width - p.gram for s in (a, b))
    assert (covered[:n] == 1).all()


def test_key_filter(spark):
    from pagewright.llm._common import key_filter

    r = np.random.default_rng(3)
    keys, others = r.integers(-(1 << 63), 1 << 63, 5000), r.integers(-(1 << 63), 1 << 63, 50_000)
    table = spark.createDataFrame([(int(k),) for k in keys], "key long")
    found = key_filter(table)
    assert found.hashes == 4 and found.has(keys).all() and found.has(others).mean() < 0.01
    full = key_filter(table, most=16)  # no room: still complete
    assert full.has(keys).all()
    assert not key_filter(table.where("false")).has(others).any()
