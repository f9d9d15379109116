"""Operator 11: the prefix trie of conversations, which shows what a cache of common beginnings would save.

Turns are dictionary-encoded: equal (role, text) have one id. Conversations are then rows of ids, equal ones are one class. Buckets of classes with a
common beginning are partitioned by their next turn id (MSD radix), round by round, until a bucket is small enough for a task; a bucket's common beginning is
skipped in one step, as the common prefix of its least and greatest row. Only buckets that are still too large take part in a round. Multikey
quicksort finishes the others in numpy, whole buckets at a time, and emits a node for each set that shares a turn; the nodes of large buckets
are folded together from the rounds, last to first.

A node is known by its least conversation and its depth. What tells hot turns, buckets and classes apart from others is counted first: the join with the
dictionary broadcasts the turns that hold more than a share of all rows (so a bounded number), large buckets are split by the rounds, classes
are pre-aggregated. Broadcast tables of large buckets have at most (all ids / bucket size) rows. A class's list of ids is hashed in
blocks that range partitions prepare; the last task of a class streams blocks, as SHA-256 needs, and holds one at a time.

Defined results: null role or text is empty; null turns come first, ties in the order of the turn's digest; repeated rows are turns of their
own; rows without conv_id belong to no conversation and are left out; an empty table has no node, not even the root. Extra columns are ignored.
A conversation is one row of 12 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stage_table, table

NODE = "p string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, turn_id long, end_key binary"


@dataclass(frozen=True)
class TrieParams:
    """A bucket of at most local_ids turn ids (fewer where that would leave tasks idle) is finished by one task. Turns with more than one row in hot_share
    are joined by broadcast. Up to max_broadcast large buckets are broadcast, more are joined by shuffle. blob_chars bounds a block of a list of ids."""

    local_ids: int = 1 << 20
    hot_share: int = 1024
    max_broadcast: int = 200_000
    blob_chars: int = 1 << 16


# --- dictionary and sequences ----------------------------------------------------------------------------------------


def _digest(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def encode(turns: DataFrame, p: TrieParams = TrieParams()) -> tuple[DataFrame, DataFrame]:
    """The dictionary (turn_id, digest, n_bytes, n_rows) of turns, and sequences: conv_id, ids and sizes (UTF-8 bytes of the texts) in order."""
    own = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes")
    )
    own = stage_table(own, "trie-turns")
    dictionary = own.groupBy("digest", "n_bytes").agg(F.count("*").alias("n_rows"))
    dictionary = stage_table(dictionary.select(F.monotonically_increasing_id().alias("turn_id"), "digest", "n_bytes", "n_rows"), "trie-dictionary")
    hot = dictionary.where(F.col("n_rows") > own.count() // p.hot_share).select("digest", F.col("turn_id").alias("hot_id"))
    marked = own.join(F.broadcast(hot), "digest", "left")
    cold = marked.where("hot_id is null").drop("hot_id").join(dictionary.select("digest", "turn_id"), "digest")
    rows = cold.unionByName(marked.where("hot_id is not null").withColumnRenamed("hot_id", "turn_id"))
    line = F.sort_array(F.collect_list(F.struct("turn", "digest", "turn_id", "n_bytes")))
    return dictionary, rows.groupBy("conv_id").agg(line.alias("line")).select("conv_id", F.col("line.turn_id").alias("ids"), F.col("line.n_bytes").alias("sizes"))


def turn_texts(turns: DataFrame, dictionary: DataFrame) -> DataFrame:
    """turn_id, role and text of the dictionary's turns."""
    texts = turns.select(_digest(F.col("role"), F.col("text")).alias("digest"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["digest"])
    return dictionary.select("turn_id", "digest").join(texts, "digest").drop("digest")


# --- buckets in a task -----------------------------------------------------------------------------------------------


class _Forest:
    """Nodes of whole buckets by multikey quicksort. Chains of nodes with the same members are one record: members order[lo:hi], depths first to last."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.ids, self.starts, self.n = ids, starts, sizes
        self.order = np.arange(len(starts))
        self.chains: list[list] = []  # lo, hi, first, last, parent, class that ends, number of the bucket

    def _digits(self, lo: int, hi: int, depth: int) -> np.ndarray:
        """Turn ids at depth; -1 for a sequence that is over."""
        own = self.order[lo:hi]
        going = self.n[own] > depth
        out = np.full(hi - lo, -1, np.int64)
        out[going] = self.ids[self.starts[own[going]] + depth]
        return out

    def add(self, lo: int, hi: int, depth: int, bucket: int) -> None:
        """Classes lo to hi share depth turns."""
        waiting = [(lo, hi, depth, -1, True)]
        while waiting:
            lo, hi, depth, parent, is_node = waiting.pop()
            if is_node:  # all share depth turns: emit the chain of nodes from here to where they differ
                chain = [lo, hi, depth, depth, parent, -1, bucket]
                parent = len(self.chains)
                self.chains.append(chain)
                if hi - lo == 1:
                    chain[3], chain[5] = max(depth, int(self.n[self.order[lo]])), int(self.order[lo])
                    continue
                digits = self._digits(lo, hi, depth)
                while (digits == digits[0]).all():  # not all can be over: classes differ
                    depth += 1
                    digits = self._digits(lo, hi, depth)
                chain[3] = depth
            else:
                digits = self._digits(lo, hi, depth)
            pivot = digits[(hi - lo) // 2]
            own = self.order[lo:hi]
            less, same, more = own[digits < pivot], own[digits == pivot], own[digits > pivot]
            self.order[lo:hi] = np.concatenate([less, same, more])
            a, b = lo + len(less), lo + len(less) + len(same)
            if len(more):
                waiting.append((b, hi, depth, parent, False))
            if pivot < 0:
                self.chains[parent][5] = int(same[0])
            else:
                waiting.append((a, b, depth + 1, parent, True))
            if len(less):
                waiting.append((lo, a, depth, parent, False))


def _emit(rows: list[tuple]) -> pa.RecordBatch:
    """rows (b, d, p, rep, n, key, ids, sizes) of whole buckets, sorted by bucket -> NODE."""
    lengths = np.array([len(r[6]) for r in rows], np.int64)
    starts = np.cumsum(lengths) - lengths
    ids = np.concatenate([np.asarray(r[6], np.int64) for r in rows])
    sizes = np.concatenate([np.asarray(r[7], np.int64) for r in rows])
    rep, n = np.array([r[3] for r in rows], np.int64), np.array([r[4] for r in rows], np.int64)
    forest = _Forest(ids, starts, lengths)
    lo = 0
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or rows[hi][0] != rows[lo][0]:
            forest.add(lo, hi, rows[lo][1], lo)
            lo = hi
    chains = forest.chains
    k = len(chains)
    order = forest.order
    conv, convs, children, leaves, saved, base = (np.zeros(k, np.int64) for _ in range(6))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(k - 1, -1, -1):  # children come after their parents
        lo, hi, first, last, parent, _, _ = chains[i]
        own = order[lo:hi]
        conv[i], convs[i] = rep[own].min(), n[own].sum()
        leaves[i] = leaves[i] or 1
        base[i] = starts[own[0]]  # any member has the chain's turns
        within = upto[base[i] + last] - upto[base[i] + max(first - 1, 0)]
        if parent >= 0:
            children[parent] += 1
            leaves[parent] += leaves[i]
            saved[parent] += saved[i] + (convs[i] - 1) * within
    first, last, parent, end, bucket = (np.array([c[j] for c in chains], np.int64) for j in (2, 3, 4, 5, 6))
    of = np.repeat(np.arange(k), last - first + 1)
    depth = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of]
    at = base[of] + depth  # one past the node's last turn
    is_first, is_last = depth == first[of], depth == last[of]
    below = upto[base[of] + last[of]] - upto[np.maximum(at - 1, base[of])]
    top = is_first & (parent[of] < 0)
    parents = np.where(is_first, conv[np.maximum(parent[of], 0)], conv[of])
    ends = [rows[end[c]][5] if f and end[c] >= 0 else None for c, f in zip(of.tolist(), is_last.tolist(), strict=True)]
    columns = [
        pa.array([rows[bucket[c]][2] if t else None for c, t in zip(of.tolist(), top.tolist(), strict=True)], pa.string()), pa.array(top), pa.array(conv[of]), pa.array(depth), pa.array(parents, mask=top), pa.array(convs[of]),
        pa.array(np.where(is_last, children[of], 1)), pa.array(leaves[of]), pa.array(saved[of] + (convs[of] - 1) * below), pa.array(ids[np.maximum(at - 1, 0)] if len(ids) else np.zeros(len(of), np.int64), mask=depth == 0), pa.array(ends, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["p", "top", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn_id", "end_key"])


def _finish(local: DataFrame, at_once: int) -> DataFrame:
    """The nodes of local's buckets; rows of a bucket lie together. A task holds at_once ids and the bucket that passes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        weight = 0
        for batch in batches:
            b, d, p, rep, n, key = (batch.column(i).to_pylist() for i in range(6))
            ids, sizes = batch.column(6), batch.column(7)
            for i in range(batch.num_rows):
                if weight > at_once and b[i] != held[-1][0]:
                    yield _emit(held)
                    held, weight = [], 0
                own = ids[i].values.to_numpy(zero_copy_only=False)
                held.append((b[i], d[i], p[i], rep[i], n[i], key[i], own, sizes[i].values.to_numpy(zero_copy_only=False)))
                weight += len(own) + 1
        if held:
            yield _emit(held)

    return local.select("b", "d", "p", "rep", "n", "key", "ids", "sizes").mapInArrow(run, NODE)


# --- rounds ----------------------------------------------------------------------------------------------------------


def _with(rows: DataFrame, small: DataFrame, count: int, on: str, p: TrieParams) -> DataFrame:
    return rows.join(F.broadcast(small) if count <= p.max_broadcast else small, on, "left")


def trie(sequences: DataFrame, p: TrieParams = TrieParams()) -> DataFrame:
    """sequences: conv_id (unique), ids, sizes. A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, turn_id of
    the last turn (null at the root), and ends_sha256 of the conversations that end there."""
    spark = sequences.sparkSession
    key = F.unhex(F.sha2(F.array_join("ids", ","), 256))
    members = stage_table(sequences.select("conv_id", key.alias("key"), "ids", "sizes"), "trie-members")
    classes = members.groupBy("key").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.first("ids").alias("ids"), F.first("sizes").alias("sizes"))
    work = stage_table(classes.select(F.lit("root").alias("b"), F.lit(0).alias("d"), F.lit(None).cast("string").alias("p"), "rep", "n", "key", "ids", "sizes"), "trie-classes")
    weight = F.sum(F.size("ids") - F.col("d") + 1)
    total = work.agg(weight).first()[0] or 0
    limit = max(1, min(p.local_ids, total // (4 * spark.sparkContext.defaultParallelism)))
    rounds: list[tuple[DataFrame, int]] = []
    local: list[DataFrame] = []
    while True:
        large = work.groupBy("b").agg(weight.alias("w"), F.count("*").alias("k"), F.min("rep").alias("conv"), F.sum("n").alias("convs")).where((F.col("w") > limit) & (F.col("k") > 1)).drop("w", "k")
        large = stage_table(large, "trie-large")
        count = large.count()
        if not count:
            local.append(work)
            break
        held = _with(work, large, count, "b", p).where("conv is not null")
        span = held.groupBy("b").agg(F.first("d").alias("d"), F.first("p").alias("p"), F.min(F.struct("ids", "sizes")).alias("least"), F.max("ids").alias("most"))
        differ = F.array_position(F.zip_with("least.ids", "most", lambda a, b: a.eqNullSafe(b)), False)
        span = span.withColumn("l", (differ - 1).cast("int"))
        # the last turns of the nodes from depth d to depth l; the root has none
        turn = lambda c, none: F.transform(F.sequence("d", "l"), lambda x: F.when(x > 0, F.get(f"least.{c}", x - 1)).otherwise(F.lit(none)))
        span = span.join(large, "b").select("b", "d", "p", "l", "conv", "convs", turn("ids", None).alias("turns"), turn("sizes", 0).alias("bytes"))
        span = stage_table(span, "trie-spans")
        dealt = stage_table(_with(work, span.select("b", "l"), count, "b", p), "trie-dealt")
        ended = dealt.where(F.size("ids") == F.col("l")).select("b", F.col("key").alias("end_key"))
        rounds.append((span.join(ended, "b", "left"), count))
        local.append(dealt.where("l is null").drop("l"))
        child = F.sha2(F.concat_ws("/", "b", F.col("l").cast("string"), F.get("ids", F.col("l")).cast("string")), 256)
        work = dealt.where(F.size("ids") > F.col("l")).select(child.alias("b"), (F.col("l") + 1).alias("d"), F.col("b").alias("p"), "rep", "n", "key", "ids", "sizes")
    rest = reduce(DataFrame.unionByName, local)
    bins = max(spark.sparkContext.defaultParallelism, -(-total // limit))
    nodes = stage_table(_finish(rest.repartition(bins, "b").sortWithinPartitions("b", "rep"), limit), "trie-nodes")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "turn_id", "end_key"]
    if rounds:
        tops = nodes.where("top and p is not null").select("p", "n_leaves", "saved_tokens")
        upper = []
        for spans, _ in reversed(rounds):
            spans, below = _fold(spans, tops)
            upper.append(spans)
            tops = below.unionByName(tops)
        known = reduce(DataFrame.unionByName, [s.select(F.col("b").alias("p"), F.col("conv").alias("above")) for s, _ in rounds])
        count = sum(c for _, c in rounds)
        heads = _with(nodes.where("top"), known, count, "p", p).withColumn("parent_conv_id", F.col("above"))
        upper = _with(reduce(DataFrame.unionByName, upper), known, count, "p", p).withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
        nodes = reduce(DataFrame.unionByName, [x.select(*columns) for x in (nodes.where("not top"), heads, upper)])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    ended = nodes.where("end_key is not null").join(_ends(members, p), F.col("end_key") == F.col("key"), "left").drop("key")
    out = nodes.where("end_key is null").withColumn("ends_sha256", none).unionByName(ended)
    return out.select(*columns[:-1], "ends_sha256")


def _fold(spans: DataFrame, tops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes of a round's large buckets from the totals of their children, and their own totals."""
    sums = tops.groupBy("p").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
    whole = spans.join(sums.withColumnRenamed("p", "b"), "b")
    at = whole.select("*", F.posexplode("turns").alias("i", "turn_id"))
    suffix = F.aggregate(F.slice("bytes", F.col("i") + 1, F.size("bytes")), F.lit(0).cast("long"), lambda s, x: s + x)
    last = F.col("i") == F.col("l") - F.col("d")
    nodes = at.select(
        F.when(F.col("i") == 0, F.col("p")).alias("p"), F.col("conv").alias("conv_id"), (F.col("d") + F.col("i")).cast("long").alias("depth"), F.when(F.col("i") > 0, F.col("conv")).alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).alias("n_children"),
        "n_leaves", (F.col("saved") + (F.col("convs") - 1) * suffix).alias("saved_tokens"), "turn_id", F.when(last, F.col("end_key")).alias("end_key"), (F.col("i") == 0).alias("top"),
    )
    nodes = stage_table(nodes, "trie-upper")
    return nodes.drop("top"), nodes.where("top and p is not null").select("p", "n_leaves", "saved_tokens")


def _ends(members: DataFrame, p: TrieParams) -> DataFrame:
    """key and ends_sha256: the hash of the ids of each class, ascending, joined by commas."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, first, ids, size = None, 0, [], 0
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or size > p.blob_chars):
                    rows.append((key, first, ",".join(ids)))
                    ids, size = [], 0
                if not ids:
                    key, first = k, c
                ids.append(str(c))
                size += len(ids[-1]) + 1
            yield _batch(rows, ("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string()))
            rows = []
        if ids:
            yield _batch([(key, first, ",".join(ids))], ("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string()))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, now = None, None
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    now.update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.append((key, now.hexdigest()))
                key, now = k, hashlib.sha256(ids.encode())
            yield _batch(rows, ("key", pa.binary()), ("ends_sha256", pa.string()))
            rows = []
        if now is not None:
            yield _batch([(key, now.hexdigest())], ("key", pa.binary()), ("ends_sha256", pa.string()))

    ids = members.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    found = ids.mapInArrow(blocks, "key binary, first long, ids string")
    return found.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def _batch(rows: list[tuple], *fields: tuple[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


# --- the query -------------------------------------------------------------------------------------------------------


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Each conversation c after the beginning of conversation c - c % 5: its first h turns, h = crc32(c) % 9, in place of c's own first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    heads = sequences.select(F.col("conv_id").alias("base"), F.slice("ids", 1, 8).alias("head_ids"), F.slice("sizes", 1, 8).alias("head_sizes"))
    both = sequences.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": h}).join(heads, "base", "left")
    line = lambda head, own: F.concat(F.slice(F.coalesce(head, F.slice(own, 1, 0)), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))
    return both.select("conv_id", line("head_ids", "ids").alias("ids"), line("head_sizes", "sizes").alias("sizes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sequences = encode(table(spark, sf_dir, "conversations"))
    return trie(rebuilt(sequences)).drop("turn_id")


#: CRC-32 of a decimal number, bit by bit (DuckDB has none).
_STEP = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)"
_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), "
    f"lambda r, x: list_reduce([xor(r, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: {_STEP})), 4294967295::BIGINT)"
)
ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(length(coalesce(role, '')), ':', role, text))) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, {_CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM (SELECT DISTINCT conv_id FROM t)),
b AS (SELECT h.*, (SELECT count(*) FROM t WHERE t.conv_id = h.base) AS n FROM h),
r AS (SELECT b.conv_id, t.p AS d, role, text FROM b JOIN t ON t.conv_id = b.base AND t.p <= b.h UNION ALL SELECT b.conv_id, least(b.h, b.n) + t.p - b.h, role, text FROM b JOIN t ON t.conv_id = b.conv_id AND t.p > b.h),
n AS (SELECT conv_id, 0 AS d, '' AS path, 0 AS bytes FROM h UNION ALL SELECT conv_id, d, string_agg(md5(concat(length(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY d), strlen(text) FROM r),
g AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, CASE WHEN d > 0 THEN left(path, (32 * (d - 1))::BIGINT) END AS up FROM n GROUP BY path, d),
k AS (SELECT up AS path, count(*) AS kids FROM g WHERE d > 0 GROUP BY up),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM n WHERE (conv_id, d) IN (SELECT (conv_id, max(d)) FROM n GROUP BY conv_id) GROUP BY path),
s AS (SELECT left(path, (32 * i)::BIGINT) AS path, sum((n_convs - 1) * bytes)::BIGINT AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM (SELECT g.*, kids, unnest(range(0, d::BIGINT + 1)) AS i FROM g LEFT JOIN k USING (path)) GROUP BY 1)
SELECT g.conv_id, g.d::BIGINT AS depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM g JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN g u ON u.path = g.up
"""
