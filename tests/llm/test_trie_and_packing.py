"""Operators 11 and 12 against brute force."""

from __future__ import annotations

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagewright.llm import packing, prefix_trie

TURNS = "conv_id long, turn long, role string, text string, depth string, key int"


def brute_sequences(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((t is not None, t or 0, digest, (role, text)))
    return {c: [x[3] for x in sorted(v)] for c, v in convs.items()}


def brute_rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def brute_trie(convs):
    nodes = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, v in nodes.items():
        own = (len(v) - 1) * len(k[-1][1].encode()) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += own
            leaves[k[:d]] += kids[k] == 0
    ends = lambda k: hashlib.sha256(",".join(map(str, sorted(c for c in nodes[k] if len(convs[c]) == len(k)))).encode()).hexdigest()
    return sorted((min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), kids[k], leaves[k], saved[k], ends(k)) for k, v in nodes.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got(nodes):
    return sorted(tuple(r[c] for c in COLUMNS) for r in nodes.collect())


def made(seed):
    """Copies, beginnings of others, a hot beginning, long conversations that differ late, ties, nulls, repeated rows."""
    r = random.Random(seed)
    turn = lambda k: (["user", "assistant", None][k % 3], None if k % 7 == 5 else "é%d" % k)
    hot = [r.randrange(30) for _ in range(12)]
    long = [r.randrange(6) for _ in range(150)]
    rows = []
    for c in [*range(-7, 60), 1_000, 10**12]:
        s = [r.randrange(3) for _ in range(r.randrange(1, 8))] if c % 3 else hot[: r.randrange(1, 13)] + [r.randrange(4) for _ in range(r.randrange(3))]
        if c % 11 == 0:
            s = long[: r.randrange(100, 151)] + [r.randrange(40)]
        if c % 13 == 0:
            s = hot[:5]
        rows += [(c, None if t == 1 and c % 4 == 0 else t // (2 if c % 5 == 0 else 1), *turn(k)) for t, k in enumerate(s)]
    rows += [(3, None, "", ""), (3, 0, "user", None), (None, 1, "user", "lost"), (8, 1, "user", "same"), (8, 1, "user", "same")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("local_ids", [30, 1 << 20])
def test_trie(spark, local_ids):
    p = prefix_trie.TrieParams(local_ids=local_ids, hot_share=20, blob_chars=8)
    rows = made(local_ids)
    turns = spark.createDataFrame([(*x, "x", 1) for x in rows], TURNS)
    dictionary, sequences = prefix_trie.encode(turns, p)
    convs = brute_sequences(rows)
    nodes = prefix_trie.trie(sequences, p)
    assert got(nodes) == brute_trie(convs)
    texts = {r["turn_id"]: (r["role"], r["text"]) for r in prefix_trie.turn_texts(turns, dictionary).collect()}
    assert len(texts) == dictionary.count() == len({t for s in convs.values() for t in s})
    for r in nodes.where("turn_id is not null").collect():
        assert texts[r["turn_id"]] == convs[r["conv_id"]][r["depth"] - 1]
    assert got(prefix_trie.trie(prefix_trie.rebuilt(sequences), p)) == brute_trie(brute_rebuilt(convs))


def test_trie_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(prefix_trie.op11_prefix_trie(spark, small)) == brute_trie(brute_rebuilt(brute_sequences(rows)))


def test_trie_sql(spark):
    """The SQL on awkward rows against brute force."""
    import duckdb
    import pandas as pd

    rows = [(c, t, role, text) for c, t, role, text in made(5)]
    conversations = pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], "Int64"), "turn": pd.array([r[1] for r in rows], "Int64"), "role": pd.array([r[2] for r in rows], "string"), "text": pd.array([r[3] for r in rows], "string")})
    c = duckdb.connect()
    c.register("conversations", conversations)
    found = c.execute(prefix_trie.ORACLE_SQL)
    names = [d[0] for d in found.description]
    got = sorted(tuple(r[names.index(k)] for k in COLUMNS) for r in found.fetchall())
    assert got == brute_trie(brute_rebuilt(brute_sequences(rows)))


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.trie(prefix_trie.encode(none)[1]).collect() == []
    one = spark.createDataFrame([(9, None, None, None, "x", 1)], TURNS)
    _, sequences = prefix_trie.encode(one)
    assert got(prefix_trie.trie(sequences)) == brute_trie({9: [("", "")]})
    lost = spark.createDataFrame([(None, 1, "a", "b", "x", 1)], TURNS)
    assert prefix_trie.trie(prefix_trie.encode(lost)[1]).collect() == []
    empty = sequences.selectExpr("conv_id", "slice(ids, 1, 0) ids", "slice(sizes, 1, 0) sizes").unionByName(sequences.selectExpr("conv_id + 1 conv_id", "slice(ids, 1, 0) ids", "slice(sizes, 1, 0) sizes"))
    assert got(prefix_trie.trie(empty)) == brute_trie({9: [], 10: []})


# --- packing ---------------------------------------------------------------------------------------------------------

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2]


def brute_pieces(doc_id, text, longest=4096):
    ids, out, start = ids_of(text), [], 0
    while start < len(ids):
        n = longest
        while n > len(ids) - start:
            n //= 2
        own = ids[start : start + n]
        out.append((doc_id, start, n, zlib.crc32(struct.pack(f"<{n}I", *own)), len(ids), tuple(own)))
        start += n
    return out


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]


def check_sequences(rows, longest=4096):
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    assert all(r["offset"] == 0 and r["length"] <= longest and r["length"] & (r["length"] - 1) == 0 for r in rows)
    by = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by] == sorted(r["length"] for r in rows)


def test_words_are_the_tokenizers():
    own = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 50, 6)
    r = random.Random(3)
    letters = [chr(k) for k in range(0x180)] + list("'''   ..,,sStTdDlLmMreREveaaeexyzé \n")
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(3_000)]
    texts += ["don't we'll I'M 's''s x's. it's, 12½²3", "<|endoftext|> a<|startoftext|>", "İ J̌ a\x1cb ΑΣ ς. é 日本 　x", "a" * 200, "word word. word... word .word", "", " \n", "a\x00b\x7fc\x85d\xa0e"]
    texts += ["a, b. c", "a,, b.", "a , b", ".", ". a", "a.\n.b", "a.\nb, c!\n", "a.b c.", "a.\tb. c", "é, ß! a?", "a.,", "word word. " * 40 + "x,y", "a! ! b"]
    for t in texts + texts[:50]:
        assert own.of(t).tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("shards", [1, 64])
def test_pack(spark, docs, awkward, no_docs, shards):
    got = packing.pack(docs, packing.PackParams(shards=shards, longest=256)).collect()
    expected = [x for row in awkward for x in brute_pieces(row[0], row[1], 256)]
    assert Counter((*(r[c] for c in PIECE), tuple(r["ids"])) for r in got) == Counter(expected)
    check_sequences(got, 256)
    again = packing.pack(docs.repartition(3), packing.PackParams(shards=shards, longest=256)).collect()
    placed = lambda rows: Counter((*(r[c] for c in PIECE), r["sequence_id"]) for r in rows)
    assert placed(got) == placed(again)
    assert packing.pack(no_docs).collect() == []


def test_pack_query(spark, small):
    got = packing.op12_packing(spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r[c] for c in PIECE) for r in got) == sorted(x[:5] for d in docs for x in brute_pieces(d["doc_id"], d["text"]))
    check_sequences(got)


def test_lengths():
    for n in [1, 2, 3, 4095, 4096, 4097, 12_289]:
        cut = packing.lengths(n, 4096)
        assert sum(cut) == n and cut == sorted(cut, reverse=True) and all(x & (x - 1) == 0 for x in cut)
