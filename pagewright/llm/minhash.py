"""Operator 5: near-duplicate documents by MinHash.

Texts become sets of word shingles; many universal hash minima make a signature; bands of the signature make
buckets; pairs of a bucket are verified first on signatures, then on the full sets; connected components come from
alternating large-star and small-star.

Sets are of 64-bit hashes of shingles: two different shingles of a pair of texts would have to have equal hashes to be taken for one.

Texts with equal sets are one class, so copies never meet in pairs. Within a bucket every class is compared with the
bucket's least class (a star, not all pairs). Classes of buckets that still hold several components afterwards are
compared across these components by an exact prefix filter, so no link is lost to the star.

Defined results: a null or empty text, or one of white space only, has an empty set and is linked with nothing
(component_id is its own id). Rows that repeat an id belong to one component. A row without id has no component and is
kept. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import only_ids, release, release_since, stage_table, table, with_matches, written_so_far
from ._vec import U, shingle_sets, slices
from .components import components


@dataclass(frozen=True)
class MinHashParams:
    """bands * rows minima. A pair at the threshold shares no band with probability (1 - t^rows)^bands: 5e-6 here.
    slack is how far below the threshold the signatures of a pair may agree: five standard deviations. A shingle that more than hot nodes have
    is compared in a grid of tasks; broadcast_rows bounds the table of them that is broadcast."""

    width: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    slack: float = 0.19
    hot: int = 256
    broadcast_rows: int = 1_000_000

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(0, 1 << 63, n, dtype=np.uint64) * U(2) + U(1), r.integers(0, 1 << 63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, n: int) -> bytes:
    """The n least values of a*x+b over the set, upper 32 bits."""
    a, b = _multipliers(n)
    low = np.full(n, ~U(0))
    for k in range(0, len(shingles), 1024):
        np.minimum(low, (a[:, None] * shingles[None, k : k + 1024] + b[:, None]).min(axis=1), out=low)
    return (low >> U(32)).astype("<u4").tobytes()


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _sketch(batches: Iterator[pa.RecordBatch], params: MinHashParams) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = _texts(batch.column(1))
        n, digest, sig = [], [], []
        for lo, hi in slices([len(t) for t in texts]):
            for s in shingle_sets(texts[lo:hi], params.width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, params.minima) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "digest", "sig"])


def _exact(batches: Iterator[pa.RecordBatch], params: MinHashParams) -> Iterator[pa.RecordBatch]:
    """a, b, text_a, text_b -> a, b of the pairs that are links; text_b is often the same as in the row before."""
    last, cached = None, None
    for batch in batches:
        ta, tb = _texts(batch.column(2)), _texts(batch.column(3))
        keep = np.zeros(len(ta), bool)
        for lo, hi in slices([len(t) for t in ta]):
            for k, s in enumerate(shingle_sets(ta[lo:hi], params.width), lo):
                if tb[k] != last:
                    last, cached = tb[k], shingle_sets([tb[k]], params.width)[0]
                common = len(np.intersect1d(s, cached, assume_unique=True))
                keep[k] = common > 0 and 100 * common >= params.percent * (len(s) + len(cached) - common)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _prefixes(batches: Iterator[pa.RecordBatch], params: MinHashParams) -> Iterator[pa.RecordBatch]:
    """All shingles of a text, as (id, shingle, set size)."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
        for lo, hi in slices([len(t) for t in texts]):
            sets = shingle_sets(texts[lo:hi], params.width)
            size = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.array(ids[lo:hi], np.int64), size)), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)), pa.array(np.repeat(size, size))], ["id", "shingle", "size"]
            )


def verify(pairs: DataFrame, signatures: DataFrame, docs: DataFrame, params: MinHashParams) -> DataFrame:
    """The pairs (a, b) that are links: enough equal minima, then the full sets. signatures: rep, sig. A leader b with more than params.hot pairs has
    copies of its signature and text in as many tasks as its pairs ask for."""
    n = params.minima
    least = int(n * (params.percent / 100 - params.slack))
    heavy = stage_table(pairs.groupBy("b").agg(F.ceil(F.count("*") / params.hot).cast("int").alias("g")).where("g > 1"), "near-heavy")
    heavy = F.broadcast(heavy) if heavy.count() <= params.broadcast_rows else heavy
    pairs = pairs.join(heavy, "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("g")), F.lit(0)).cast("int").alias("salt"))
    copies = lambda rows: rows.join(heavy, "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("g", F.lit(1)) - 1))).drop("g")
    signed = pairs.join(signatures.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(copies(signatures.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))), ["b", "salt"])
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(4 * n), F.lit(4)), lambda i: F.col("sa").substr(i, F.lit(4)) == F.col("sb").substr(i, F.lit(4))))
    likely = stage_table(signed.where(equal >= least).select("a", "b", "salt"), "near-likely")
    ids = likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct()
    texts = stage_table(only_ids(docs, ids), "near-texts")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"t{x}"))
    full = likely.join(side("a"), "a").join(copies(side("b")), ["b", "salt"]).select("a", "b", "ta", "tb").sortWithinPartitions("b")
    out = stage_table(full.mapInArrow(partial(_exact, params=params), "a long, b long"), "near-links")
    release(likely)
    release(texts)
    return out


def _across(nodes: DataFrame, docs: DataFrame, params: MinHashParams) -> DataFrame:
    """nodes: rep, label. Pairs (a, b) of different labels that may be links, by prefix filter: two sets with similarity t
    share one of the size - ceil(t * size) + 1 rarest shingles of each. From the first shingle that they share, each
    must have enough shingles left for the common part. Shingles that a single node has can't be shared, so a node with
    too many of them is in no pair; a shingle with one label needs no pair."""
    t = params.percent
    shingles = stage_table(only_ids(docs, nodes.select(F.col("rep").alias("doc_id"))).mapInArrow(partial(_prefixes, params=params), "id long, shingle long, size long").distinct(), "near-shingles")
    common = shingles.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = shingles.join(common, "shingle")
    own = shared.groupBy("id").agg(F.count("*").alias("shared"), F.max("size").alias("_size")).where(F.col("shared") * 100 >= F.col("_size") * t).drop("_size")
    by_rarity = Window.partitionBy("id").orderBy("df", "shingle")
    ranked = shared.join(own, "id").withColumn("at", F.row_number().over(by_rarity) + F.col("size") - F.col("shared"))
    prefix = ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * t / 100) + 1).join(nodes.select(F.col("rep").alias("id"), "label"), "id")
    prefix = stage_table(prefix.select("id", "shingle", "size", (F.col("size") - F.col("at") + 1).alias("rest"), "label"), "near-prefix")
    release(shingles)
    of = prefix.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"))
    mixed = stage_table(of.where("x < y").select("shingle", "n"), "near-mixed")
    hot = mixed.where(F.col("n") > params.hot).select("shingle", F.ceil(F.col("n") / params.hot).cast("int").alias("g"))
    n_hot = hot.count()
    enough = (100 + t) * F.least("rest", "rb") >= t * (F.col("size") + F.col("sb"))

    def met(keys: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
        right = right.select(*keys, F.col("id").alias("b"), F.col("size").alias("sb"), F.col("rest").alias("rb"), F.col("label").alias("lb"))
        return left.join(right, keys).where((F.col("label") < F.col("lb")) & enough).select(F.col("id").alias("a"), "b")

    if not n_hot:
        cold = prefix.join(mixed, "shingle", "left_semi")
        return met(["shingle"], cold, cold).distinct()
    if n_hot <= params.broadcast_rows:  # else shuffled: then the nodes of a hot shingle are read by one task before they are dealt out
        hot = F.broadcast(hot)
    cold = prefix.join(hot, "shingle", "left_anti").join(mixed, "shingle", "left_semi")
    # g parts of the nodes of a hot shingle on each side: each of g * g tasks compares one part with another
    dealt = prefix.join(hot, "shingle").withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    spread = lambda own, other: dealt.withColumn(own, F.col("part")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    return met(["shingle"], cold, cold).unionByName(met(["shingle", "i", "j"], spread("i", "j"), spread("j", "i"))).distinct()


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stage_table(docs.mapInArrow(partial(_sketch, params=params), "doc_id long, n_shingles long, digest binary, sig binary"), "near-sketch")
    classes = stage_table(sketch.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "near-classes")
    width = 4 * params.rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(params.bands - 1)), lambda i: F.xxhash64(i, F.col("sig").substr(i * width + 1, F.lit(width))))
    bands = classes.select("rep", F.explode(keys).alias("key"))
    shared = bands.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").select("key", "leader")
    buckets = stage_table(bands.join(shared, "key"), "near-buckets")
    tried = stage_table(buckets.where("rep != leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "near-stars")
    links = verify(tried, classes, docs, params)
    # the same id with several sets: one component
    member = stage_table(sketch.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n_shingles", "rep"), "near-members")
    release(sketch)
    same = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
    links = stage_table(links.unionByName(same), "near-edges")
    label = stage_table(components(links), "near-labels")
    labelled = buckets.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("key")
    nodes = stage_table(labelled.join(open_keys, "key", "left_semi").select("rep", "label").distinct(), "near-open")
    mark = written_so_far()
    more = stage_table(_across(nodes, docs, params).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "near-more")
    release_since(mark, more)
    if not more.isEmpty():
        extra = verify(more, classes, docs, params)
        if not extra.isEmpty():
            label = stage_table(components(links.unionByName(extra)), "near-labels")
    for df in (classes, buckets, tried, links, nodes, more):
        release(df)
    out = member.join(label.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("label", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; columns of docs. Rows that repeat a kept
    id are kept as one, rows without id or words all stay."""
    found = near_duplicates(docs, params).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    keyed = docs.withColumn("_gone", F.col("doc_id").cast("long"))
    known, unknown = keyed.where("_gone is not null"), keyed.where("_gone is null")
    return with_matches(known, stage_table(found, "near-gone"), ["_gone"], "left_anti").unionByName(unknown).select(*docs.columns)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
