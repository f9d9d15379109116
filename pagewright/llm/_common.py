"""What the training-data operators share: table access and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import math
import tempfile
import threading
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression of the words of every contract: runs of anything but ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []
#: The thread that wrote a table.
_by: dict[str, int] = {}


#: Bytes of an Arrow batch that a Python worker gets at once, where the session sets no limit of its own.
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Rows may be very long texts: bound Arrow batches by bytes, not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none (tests)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = getattr(spark.sparkContext, "_pagewright_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="pagewright-")
        spark.sparkContext._pagewright_dir = own
        _written.append((spark, own))
    return own


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    _by[path] = threading.get_ident()
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    limit_batches(df.sparkSession)
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._pagewright_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Delete a table of stage_table() that nothing reads any more."""
    path = getattr(df, "_pagewright_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [w for w in _written if w[1] != path]


def written_so_far() -> set[str]:
    return {path for _, path in _written}


def release_since(before: set[str], kept: DataFrame) -> None:
    """Delete all tables that this thread has written since written_so_far() gave before, but for kept: its rows are written, so nothing reads those
    that led to it."""
    path = getattr(kept, "_pagewright_path", None)
    gone = [(spark, p) for spark, p in _written if p not in before and p != path and _by.get(p) == threading.get_ident()]
    for spark, p in gone:
        _delete(spark, p)
        _by.pop(p, None)
    _written[:] = [w for w in _written if w not in gone]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            pass


def let(value: Column, body) -> Column:
    """body(value) with value computed once, by binding it to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus (null for a null id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


MAX_FILTER_BITS = 30


def filter_bits(keys: int, most: int = MAX_FILTER_BITS) -> int:
    """Bits of a filter for so many keys: 16 a key at least, between 2^16 and 2^most bits (128 MB)."""
    return min(most, max(16, math.ceil(math.log2(max(1, keys) * 16))))


@dataclass(frozen=True)
class KeyFilter:
    """A Bloom filter of longs: true for all that it was made of, and for few others (one in 400 while it has room)."""

    data: np.ndarray
    bits: int
    hashes: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        mask = (1 << self.bits) - 1
        low, step = keys & mask, (keys.view(np.uint64) >> np.uint64(32)).view(np.int64) & mask | 1
        out = np.ones(len(keys), bool)
        for i in range(self.hashes):
            at = (low + i * step) & mask
            out &= (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


def key_filter(keys: DataFrame, count: int | None = None, most: int = MAX_FILTER_BITS) -> KeyFilter:
    """Of keys.key, built in parts of 4 KB by Spark: 2^most bits in all, however many keys."""
    count = keys.count() if count is None else count
    bits = filter_bits(count, most)
    hashes = max(1, min(4, int(0.69 * (1 << bits) / max(1, count))))
    mask = F.lit((1 << bits) - 1)
    step = F.shiftrightunsigned("key", 32).bitwiseAND(mask).bitwiseOR(F.lit(1))
    places = F.array(*[(F.col("key").bitwiseAND(mask) + i * step).bitwiseAND(mask) for i in range(hashes)])
    parts = keys.select(F.explode(places).alias("k")).groupBy(F.floor(F.col("k") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("k") % 32768).alias("bits"))
    out = np.zeros((1 << bits) >> 3, np.uint8)
    for r in parts.toLocalIterator():
        out[r["part"] * 4096 : r["part"] * 4096 + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return KeyFilter(out, bits, hashes)


def maybe_in(keys: DataFrame):
    """A test of a long column: true if it is in keys.key, and for some values that aren't. The filter behind it is broadcast; its
    size is bounded."""
    held = keys.sparkSession.sparkContext.broadcast(key_filter(keys))

    @F.arrow_udf("boolean")
    def test(k: pa.Array) -> pa.Array:
        return pa.array(held.value.has(k.to_numpy(zero_copy_only=False)))

    return test


def only_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of docs whose id is in ids (both in column). Only rows that may be in ids are shuffled; the join is exact."""
    key = F.xxhash64(column)
    return docs.where(maybe_in(ids.select(key.alias("key")))(key)).join(ids, column, "left_semi")


def with_matches(docs: DataFrame, found: DataFrame, columns: list[str], how: str) -> DataFrame:
    """docs joined to found (a written table) by columns, none of them null; how is left or left_anti. Rows that surely have no
    match aren't shuffled."""
    key = F.xxhash64(*columns)
    test = maybe_in(found.select(key.alias("key")).distinct())
    near, far = docs.where(test(key)), docs.where(~test(key))
    joined = near.join(found, columns, how)
    return joined.unionByName(far, allowMissingColumns=True)
