"""Operator 9: WARC archives and revisit resolution.

Payload digests are shuffled as headers only; of the records with equal payloads the least page becomes the response,
the others become revisit records that refer to it. Archives are written record by record (gzip members) in parts of
bounded size, through the file system that the cluster's shared folder names. A part's name holds the attempt of the task that
wrote it; ``write_archives`` returns the parts of the attempts that won, and reading opens these alone, so parts that a
lost or slower attempt left behind don't count, however it cut them. Reading resolves revisit records by joining them to the responses
they refer to.

Defined results: a null html is an empty payload; payloads under ``least`` bytes are all responses; rows that repeat page
and payload make one response and revisits of it; a null page id comes after all others; a null url gives the record
a target of its own. Extra columns are ignored; an empty table gives an empty archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import maybe_in, stage_path, stage_table, table

_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """Payloads under least bytes are never revisits. A part is closed when it has part_bytes; level is that of gzip; date is every record's."""

    least: int = 100
    part_bytes: int = 16 << 20
    level: int = 1
    date: str = "2024-01-01T00:00:00Z"


def record_id(page: str | None, url: str | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, repr((page, url, digest, copy)))}>"


def _field(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(kind: str, own_id: str, page: str | None, url: str | None, digest: str, payload: bytes, refers: str | None, refers_url: str | None, p: WarcParams) -> bytes:
    """One record as a gzip member."""
    target = _field(url) if url else f"urn:page:{page}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", own_id), ("WARC-Date", p.date), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if page is not None:
        head.append(("WARC-Page-ID", page))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers or ""), ("WARC-Refers-To-Target-URI", _field(refers_url) if refers_url else "urn:page:")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    raw = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + body + b"\r\n\r\n"
    z = zlib.compressobj(p.level, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def decode(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and payload of each record of an archive."""
    while data:
        z = zlib.decompressobj(31)
        raw = z.decompress(data) + z.flush()
        if not z.eof:
            raise ValueError("truncated WARC member")
        data = z.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines)
        body = rest[: int(fields["Content-Length"])]
        yield fields, body.partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], folder: str, p: WarcParams) -> Iterator[pa.RecordBatch]:
    """page, url, digest, copy, html, first_page, first_url, is_first -> names of the parts."""
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    task = TaskContext.get()
    names: list[str] = []
    members: list[bytes] = []
    size = 0

    def flush() -> None:
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names):05d}.warc.gz"
        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as out:
            for m in members:
                out.write(m)
        store.move(temporary, f"{root}/{name}")
        names.append(name)

    for batch in batches:
        for page, url, digest, copy, html, first_page, first_url, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = record_id(page, url, digest, copy)
            kind = "response" if first else "revisit"
            member = encode(kind, own, page, url, digest, (html or "").encode(), None if first else record_id(first_page, first_url, digest, 1), first_url, p)
            members.append(member)
            size += len(member)
            if size >= p.part_bytes:
                flush()
                members.clear()
                size = 0
    if members:
        flush()
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "record_id", "record_type", "payload_digest", "payload_bytes", "refers_record"]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for f, payload in decode(content.as_py()):
                digest = f["WARC-Payload-Digest"].removeprefix("sha256:")
                whole = f["WARC-Type"] == "response"
                if whole and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"digest of {f['WARC-Record-ID']} does not match its payload")
                page = f.get("WARC-Page-ID")
                rows.append((None if page is None else int(page), f["WARC-Record-ID"], f["WARC-Type"], digest, len(payload) if whole else None, f.get("WARC-Refers-To")))
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def write_archives(pages: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """Write page_id, url, html as deduplicated archives under folder; the names of the parts."""
    base = pages.select(F.col("page_id").cast("string").alias("page"), F.col("page_id").cast("long").alias("number"), "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha2("html", 256))
    headers = base.select("page", "number", "url", "digest", F.octet_length("html").alias("n"))
    repeated = stage_table(headers.groupBy("digest").agg(F.count("*").alias("rows")).where("rows > 1").select("digest"), "warc-repeated")
    alone = lambda x: x.select("page", "url", "digest", F.lit(1).alias("copy"), "html", F.lit(None).cast("string").alias("first_page"), F.lit(None).cast("string").alias("first_url"), F.lit(True).alias("is_first"))
    if repeated.isEmpty():
        rows = alone(base)
    else:
        # payloads that occur once are responses and stay where they are; only the others are shuffled
        key = F.xxhash64("digest")
        test = maybe_in(repeated.select(key.alias("key")))
        rows = alone(base.where(~test(key))).unionByName(_resolved(base.where(test(key)), headers.join(repeated, "digest", "left_semi"), p))
    return stage_table(rows.mapInArrow(partial(_write, folder=folder, p=p), "name string"), "warc-parts")


def _resolved(base: DataFrame, headers: DataFrame, p: WarcParams) -> DataFrame:
    """base with the first record of each payload; headers are those of the payloads that occur again."""
    order = F.struct(F.col("number").isNull().alias("last"), F.col("number").alias("number"), F.coalesce("url", F.lit("")).alias("u"), F.col("page").alias("page"), F.col("url").alias("url"))
    # written, so that the headers of one digest can be split over tasks when they are joined to it
    first = stage_table(headers.where(F.col("n") >= p.least).groupBy("digest").agg(F.min(order).alias("first")), "warc-first")
    known = headers.distinct().join(first, "digest", "left")
    same = F.col("page").eqNullSafe(F.col("first.page")) & F.col("url").eqNullSafe(F.col("first.url"))
    known = known.select(
        F.coalesce("page", F.lit("")).alias("kp"), F.coalesce("url", F.lit("")).alias("ku"), F.col("url").isNull().alias("kn"), F.col("digest").alias("kd"), (F.col("first").isNull() | same).alias("lead"), F.col("first").isNull().alias("small"), F.col("first.page").alias("first_page"), F.col("first.url").alias("first_url")
    )
    keyed = base.withColumns({"kp": F.coalesce("page", F.lit("")), "ku": F.coalesce("url", F.lit("")), "kn": F.col("url").isNull(), "kd": F.col("digest")})
    # a row that the bit map let through without need has no header here: it is alone
    joined = keyed.join(known, ["kp", "ku", "kn", "kd"], "left").withColumns({"small": F.coalesce("small", F.lit(True)), "lead": F.coalesce("lead", F.lit(True))})
    copy = F.row_number().over(Window.partitionBy("kp", "ku", "kn", "kd").orderBy("number"))
    return joined.withColumn("copy", copy).select("page", "url", "digest", "copy", "html", "first_page", "first_url", (F.col("small") | (F.col("lead") & (F.col("copy") == 1))).alias("is_first"))


def read_archives(spark: SparkSession, folder: str, parts: DataFrame) -> DataFrame:
    """One row for each record of the parts."""
    if parts.isEmpty():
        return spark.createDataFrame([], "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_record string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    wanted = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(parts, "name", "left_semi").select("content")
    return wanted.mapInArrow(_read, "page_id long, record_id string, record_type string, payload_digest string, payload_bytes long, refers_record string")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Records with the page and the payload size of the response that a revisit refers to."""
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full"))
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    seen = records.where("record_type <> 'response'").drop("payload_bytes").join(originals, "refers_record").withColumnRenamed("full", "payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*columns).unionByName(seen.select(*columns))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "warc")
    parts = write_archives(table(spark, sf_dir, "pages"), folder)
    return resolve_revisits(stage_table(read_archives(spark, folder, parts), "warc-records"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM d
"""
