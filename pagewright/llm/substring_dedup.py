"""Operator 6: removal of repeated substrings with suffix arrays.

A symbol goes if it lies in a string of width symbols that begins anywhere else too. Symbols are bytes, or words with
``unit`` "words" (case counts, white space between words doesn't): words are compared by 64-bit hashes, bytes as they are.
Comparing every position of a corpus with every other is avoided without losing one:

1. Every window of width symbols picks the least hash among its k-grams (its anchor). Equal windows pick equal anchors at
   equal places, so windows are compared only within one anchor hash. Each window belongs to exactly one anchor.
2. The windows of an anchor occurrence span a segment. Segments that occur twice as a whole are repeated throughout; this
   is a count with map-side sums, so large groups of copies collapse before the shuffle. Anchors that occur once have
   nothing repeated.
3. What is left, anchors with several different segments, goes to shards by anchor. Each shard builds a suffix array
   (Larsson-Sadakane refinement), its common prefixes (Kasai) and marks windows of width equal symbols; an anchor with more
   bytes than a shard holds is cut into shards that are merged by binary search.
4. An anchor with more than ``group_limit`` different segments is split first: windows are halved by their place
   relative to the anchor, and segments are regrouped by the bytes that all windows of a half share.

Defined results: a null text is empty; texts shorter than width lose nothing; rows that repeat id and text count as
two documents and both lose what they share. A null id is allowed. Where removal cuts a UTF-8 character in two,
``remove_repeats`` drops the bytes that are left of it. Words go with the white space behind them. Extra columns are kept
by ``remove_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MAX_FILTER_BITS, key_filter, release, stage_table, table, with_matches
from ._vec import _PLAIN, U, mix, powers, run_hashes, word_bounds
from .suffix_array import repeated_starts


@dataclass(frozen=True)
class SubstringParams:
    """width and gram count symbols: bytes or words, by unit. max_filter_bits bounds the filter that is broadcast; with more keys
    than it can tell apart, the shards only get more segments. An anchor with more than group_limit segments is split; shard_bytes is what one
    suffix array is built of."""

    width: int = 400
    gram: int = 100
    unit: str = "bytes"
    group_limit: int = 512
    shard_bytes: int = 1 << 20
    max_filter_bits: int = MAX_FILTER_BITS

    @property
    def symbol_bytes(self) -> int:
        return 8 if self.unit == "words" else 1


#: Repeated passages of running text: 50 words and more.
PASSAGES = SubstringParams(width=50, gram=12, unit="words")


def symbols(text: bytes, p: SubstringParams) -> tuple[np.ndarray, bytes]:
    """A number for each symbol of the text, and the symbols as bytes, symbol_bytes each."""
    buf = np.frombuffer(text, np.uint8)
    if p.unit == "bytes":
        return _PLAIN[buf], text
    words = run_hashes(buf, *word_bounds(buf), fold=False)
    return words, words.tobytes()


def anchors(values: np.ndarray, p: SubstringParams) -> tuple[np.ndarray, ...]:
    """Of each anchor: hash, place, first and last window that picked it (the rightmost least k-gram of the window)."""
    n, w = len(values), p.width - p.gram + 1
    if n < p.width:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none, np.zeros(1, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=total[1:])
    h = mix((total[p.gram :] - total[: -p.gram]) * down[: n - p.gram + 1])
    m = len(h)
    blocks = np.concatenate([h, np.full(-m % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    # the last place of a value up to a window's end: places are few, so go run by run
    cut = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    end = np.append(cut[1:], len(least)) - 1
    place, lo, hi = [], [], []
    candidates = np.flatnonzero(np.isin(h, least[cut]))
    value = h[candidates]
    by = np.lexsort((candidates, value))
    value, candidates = value[by], candidates[by]
    a = np.searchsorted(value, least[cut], "left")
    b = np.searchsorted(value, least[cut], "right")
    one = b - a == 1
    place.append(candidates[a[one]])
    lo.append(cut[one])
    hi.append(end[one])
    for k in np.flatnonzero(~one).tolist():
        own = candidates[a[k] : b[k]]
        s, e = int(cut[k]), int(end[k])
        own = own[(own >= s) & (own < e + w)]
        # window x picks the last of own that is below x + w
        first = np.maximum(own - w + 1, s)
        last = np.append(first[1:] - 1, e)
        ok = first <= last
        place.append(own[ok])
        lo.append(first[ok])
        hi.append(last[ok])
    place, lo, hi = np.concatenate(place), np.concatenate(lo), np.concatenate(hi)
    return h[place], place, lo, hi, total


def _texts(column) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _segment_hashes(total: np.ndarray, place: np.ndarray, lo: np.ndarray, hi: np.ndarray, p: SubstringParams) -> np.ndarray:
    _, down = powers(len(total))
    where = (place - lo).astype(np.uint64) << U(16) | (hi - lo).astype(np.uint64)
    return mix((total[hi + p.width] - total[lo]) * down[lo] ^ mix(where + U(1)))


_ANCHOR_ROW = "dk long, th long, f long, e long, p int, lo int, hi int"


def _anchor_rows(batches: Iterator[pa.RecordBatch], p: SubstringParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for dk, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
            f, place, lo, hi, total = anchors(symbols(text, p)[0], p)
            if len(f):
                e = _segment_hashes(total, place, lo, hi, p)
                parts.append((np.full(len(f), dk), np.full(len(f), th), f.view(np.int64), e.view(np.int64), place, lo, hi))
        if parts:
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns[:4]] + [pa.array(c.astype(np.int32)) for c in columns[4:]], ["dk", "th", "f", "e", "p", "lo", "hi"])


_SEGMENT_ROW = "f long, dk long, th long, p int, lo int, hi int, seg binary"


def _key(f, e, p, dk: int, th: int) -> np.ndarray:
    return f ^ e ^ p ^ dk ^ th


def _segments(batches: Iterator[pa.RecordBatch], p: SubstringParams, held: Broadcast) -> Iterator[pa.RecordBatch]:
    """The segments, with bytes, of the anchor occurrences that the filter has."""
    schema = pa.schema([("f", pa.int64()), ("dk", pa.int64()), ("th", pa.int64()), ("p", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("seg", pa.binary())])
    wanted = held.value
    for batch in batches:
        out, size = [], 0
        for dk, th, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2)), strict=True):
            values, data = symbols(text, p)
            f, place, lo, hi, total = anchors(values, p)
            if not len(f):
                continue
            e = _segment_hashes(total, place, lo, hi, p)
            hit = np.flatnonzero(wanted.has(_key(f.view(np.int64), e.view(np.int64), place, dk, th)))
            for k in hit.tolist():
                seg = data[lo[k] * p.symbol_bytes : (hi[k] + p.width) * p.symbol_bytes]
                out.append((f[k].view(np.int64).item(), dk, th, int(place[k]), int(lo[k]), int(hi[k]), seg))
                size += len(seg)
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _reach(group: np.ndarray, parts: list[bytes], width: int) -> np.ndarray:
    """The longest common prefix of each part with another part of its group (too long at most by zero bytes)."""
    column = np.array(parts, f"S{width}")
    order = np.lexsort((column, group))
    rows = column[order].view(np.uint8).reshape(len(parts), width)
    differ = rows[1:] != rows[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    g = group[order]
    common = np.where(g[1:] == g[:-1], common, -1)
    best = np.full(len(parts), -1)
    best[1:] = common
    best[:-1] = np.maximum(best[:-1], common)
    out = np.empty(len(parts), np.int64)
    out[order] = best
    return out


def _covered(rows: list[tuple], p: SubstringParams) -> tuple[list, ...]:
    """rows: (f, dk, th, p, lo, hi, seg). The covered ranges (dk, th, from, to)."""
    f = np.array([r[0] for r in rows], np.int64)
    at, lo, hi = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
    one, width = p.symbol_bytes, p.width * p.symbol_bytes
    rel = (at - lo) * one
    segs = [r[6] for r in rows]
    right = _reach(f, [s[r:] for s, r in zip(segs, rel.tolist(), strict=True)], width) // one
    left = _reach(f, [s[:r][::-1] or b"\0" for s, r in zip(segs, rel.tolist(), strict=True)], width) // one
    # windows that reach farther than any other segment agrees can't be repeated
    a = np.where(left < 0, 1, np.maximum(lo, at - left))
    b = np.where(left < 0, 0, np.minimum(hi, at + right - p.width))
    use = np.flatnonzero(a <= b)
    if not len(use):
        return [], [], [], []
    texts, asked = [], []
    for k in use.tolist():
        s, n = int(a[k] - lo[k]) * one, int(b[k] - a[k]) * one
        texts.append(np.frombuffer(segs[k], np.uint8)[s : s + n + width])
        mask = np.zeros(n + width, bool)
        mask[: n + 1 : one] = True
        asked.append(mask)
    out: tuple[list, ...] = ([], [], [], [])
    for k, mask in zip(use.tolist(), repeated_starts(texts, asked, width, p.shard_bytes), strict=True):
        edge = np.flatnonzero(np.diff(mask[::one].astype(np.int8), prepend=0, append=0))
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            for c, v in zip(out, (rows[k][1], rows[k][2], int(a[k]) + s, int(a[k]) + e - 1 + p.width), strict=True):
                c.append(v)
    return out


def _shards(batches: Iterator[pa.RecordBatch], p: SubstringParams) -> Iterator[pa.RecordBatch]:
    """Segments in the order of f -> covered ranges. Whole anchors are put together up to the size of a shard."""
    held: list[tuple] = []
    size = 0
    names = ["dk", "th", "s", "t"]

    def flush() -> Iterator[pa.RecordBatch]:
        c = _covered(held, p)
        if c[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())], names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > p.shard_bytes and row[0] != held[-1][0]:
                yield from flush()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield from flush()


def _status(rows: DataFrame, name: str) -> DataFrame:
    """rows: f, e, dk, th, p (and more, taken from the least occurrence). One row for each f with several occurrences and
    each e of it: c, the number of occurrences; n, the number of different e of the f."""
    ids = ["dk", "th", "p"]
    rest = [c for c in rows.columns if c not in ("f", "e", *ids)]
    one = rows.groupBy("f", "e").agg(F.count("*").alias("c"), F.min(F.struct(*ids, *rest)).alias("rep"))
    many = one.groupBy("f").agg(F.count("*").alias("n"), F.sum("c").alias("total")).where("total > 1").select("f", "n")
    return stage_table(one.join(many, "f").select("f", "e", "c", "n", "rep.*"), name)


def _halves(rows: DataFrame, p: SubstringParams) -> DataFrame:
    """rows: f, dk, th, p, lo, hi, seg, near, far: windows near to far symbols before the anchor. Each half of them, regrouped
    by the symbols that all windows of the half have."""
    mid = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
    halves = F.array(F.struct(F.col("near").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("far").alias("b")))
    x = rows.withColumn("_half", F.explode(halves)).select("*", "_half.a", "_half.b").where("a <= b").drop("_half")
    x = x.withColumn("o1", F.greatest("a", F.col("p") - F.col("hi"))).withColumn("o2", F.least("b", F.col("p") - F.col("lo"))).where("o1 <= o2")
    one = p.symbol_bytes
    piece = lambda s, n: F.col("seg").substr(((s - F.col("lo")) * one + 1).cast("int"), (n * one).cast("int"))
    core = piece(F.col("p") - F.col("a"), F.lit(p.width) - (F.col("b") - F.col("a")))
    own = piece(F.col("p") - F.col("o2"), F.lit(p.width) + F.col("o2") - F.col("o1"))
    x = x.withColumn("g", F.xxhash64("f", "a", "b", core)).withColumn("own", own)
    return x.select(
        F.col("g").alias("f"), F.xxhash64("own", "o1", "o2").alias("e"), "dk", "th", "p", (F.col("p") - F.col("o2")).cast("int").alias("lo"), (F.col("p") - F.col("o1")).cast("int").alias("hi"), F.col("own").alias("seg"), F.col("a").alias("near"), F.col("b").alias("far")
    )


def repeated_ranges(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """docs: dk, th, text. (dk, th, ranges): the ranges (s, t) of symbols of that text that are covered by repeated strings; they
    may overlap. The tables that lead there are deleted."""
    spark = docs.sparkSession
    temporary: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        temporary.append(df)
        return df

    def done(out: DataFrame) -> DataFrame:
        lists = stage_table(out.groupBy("dk", "th").agg(F.collect_set(F.struct("s", "t")).alias("ranges")), "sub-ranges")
        for df in temporary:
            release(df)
        return lists

    rows = kept(stage_table(docs.mapInArrow(partial(_anchor_rows, p=p), _ANCHOR_ROW), "sub-anchors"))
    status = kept(_status(rows.select("f", "e", "dk", "th", "p"), "sub-status"))
    whole = status.where("c > 1").select("f", "e")
    out = rows.join(whole, ["f", "e"], "left_semi").select("dk", "th", F.col("lo").alias("s"), (F.col("hi") + p.width).alias("t"))
    open_ = status.where("n > 1")
    n = open_.count()
    if n == 0:
        return done(out)
    key = F.col("f").bitwiseXOR(F.col("e")).bitwiseXOR(F.col("p").cast("long")).bitwiseXOR(F.col("dk")).bitwiseXOR(F.col("th"))
    held = spark.sparkContext.broadcast(key_filter(open_.select(key.alias("key")), n, p.max_filter_bits))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    hot = stage_table(open_.where(F.col("n") > p.group_limit).select("f").distinct(), "sub-hot")
    segments = docs.mapInArrow(partial(_segments, p=p, held=held), _SEGMENT_ROW)
    search = [segments]
    if not hot.isEmpty():
        segments = kept(stage_table(segments, "sub-segments"))
        search = [segments.join(hot, "f", "left_anti")]
        now = segments.join(hot, "f", "left_semi").withColumns({"near": F.lit(0), "far": F.lit(p.width - p.gram)})
        while True:
            now = kept(stage_table(_halves(now, p), "sub-halves"))
            state = kept(_status(now, "sub-status"))
            out = out.unionByName(now.join(state.where("c > 1").select("f", "e"), ["f", "e"], "left_semi").select("dk", "th", F.col("lo").alias("s"), (F.col("hi") + p.width).alias("t")))
            columns = ["f", "dk", "th", "p", "lo", "hi", "seg"]
            search.append(state.where((F.col("n") > 1) & (F.col("n") <= p.group_limit)).select(*columns))
            now = state.where(F.col("n") > p.group_limit).select(*columns, "near", "far")
            if now.isEmpty():
                break
    every = search[0]
    for x in search[1:]:
        every = every.unionByName(x)
    sharded = every.repartition(max(int(parts), 16), "f").sortWithinPartitions("f").mapInArrow(partial(_shards, p=p), "dk long, th long, s int, t int")
    return done(out.unionByName(kept(stage_table(sharded, "sub-covered"))))


def _merged(text: bytes, ranges: list[dict] | None, p: SubstringParams) -> list[tuple[int, int]]:
    """The ranges as maximal runs of bytes; words with the white space up to the next word."""
    out: list[list[int]] = []
    for s, t in sorted((r["s"], r["t"]) for r in ranges or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], t)
        else:
            out.append([s, t])
    if out and p.unit == "words":
        at = np.append(word_bounds(np.frombuffer(text, np.uint8))[0], len(text)).tolist()
        return [(at[s], at[t]) for s, t in out]
    return [(s, t) for s, t in out]


def _kept(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    last, parts = 0, []
    for s, t in ranges:
        parts.append(text[last:s])
        last = t
    return b"".join([*parts, text[last:]])


def _digests(batches: Iterator[pa.RecordBatch], p: SubstringParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        ranges = [_merged(t, r, p) for t, r in zip(texts, batch.column(2).to_pylist(), strict=True)]
        cut = [sum(t - s for s, t in r) for r in ranges]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(cut, pa.int64()), pa.array([len(r) for r in ranges], pa.int64()), pa.array([hashlib.sha256(_kept(t, r)).hexdigest() for t, r in zip(texts, ranges, strict=True)])],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )


def _shortened(batches: Iterator[pa.RecordBatch], text_at: int, p: SubstringParams) -> Iterator[pa.RecordBatch]:
    """Replace the text by what is left; the last column has the ranges."""
    for batch in batches:
        texts = _texts(batch.column(text_at))
        ranges = [_merged(t, r, p) for t, r in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
        new = pa.array([_kept(t, r).decode("utf-8", "ignore") if r else None for t, r in zip(texts, ranges, strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], new], [*batch.schema.names[:-1], "_left"])


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({"_dk": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "_th": F.xxhash64(text)})


def _with_ranges(docs: DataFrame, p: SubstringParams) -> DataFrame:
    keyed = _keyed(docs)
    lists = repeated_ranges(keyed.select(F.col("_dk").alias("dk"), F.col("_th").alias("th"), "text"), p)
    lists = lists.withColumnsRenamed({"dk": "_dk", "th": "_th", "ranges": "_ranges"})
    return with_matches(keyed, lists, ["_dk", "_th"], "left").drop("_dk", "_th")


def substring_digests(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    found = _with_ranges(docs.select("doc_id", "text"), p).select("doc_id", "text", "_ranges")
    return found.mapInArrow(partial(_digests, p=p), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, p: SubstringParams = SubstringParams()) -> DataFrame:
    """docs with text without its repeated strings; n_chars, if there, is the new length."""
    columns = docs.columns
    found = _with_ranges(docs, p).select(*columns, "_ranges")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", _left string"
    cut = found.mapInArrow(partial(_shortened, text_at=columns.index("text"), p=p), schema)
    out = {"text": F.coalesce("_left", "text")}
    if "n_chars" in columns:
        out["n_chars"] = F.when(F.col("_left").isNull(), F.col("n_chars")).otherwise(F.length("_left").cast("long"))
    return cut.withColumns(out).select(*columns)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_digests(table(spark, sf_dir, "documents"))
