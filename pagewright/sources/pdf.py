"""PDF folders as a data source: a row for each page, splits planned by size, pages counted without rendering.

``spark.dataSource.register(PdfPages)``, then ``spark.read.format("pdf_pages").load(folder)``. Small files are grouped to splits of about ``split_bytes``; a larger file
is several splits, each of which takes its share of the pages, so planning opens no file. With the option ``decoder`` ("module:function", called with the
content, the zoom and the page numbers wanted) content is the pages' images, else null.

A file that isn't a PDF, or whose page tree can't be read, has one row with its error and no page. Folders are read through Arrow's file systems.
"""

from __future__ import annotations

import importlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import store

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+\d{1,5}\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = rb"\s+(\d+)\s+\d+\s+R\b"
_LAST = 10**10 - 1  # the largest number of an object


def _definitions(content: bytes) -> Iterator[tuple[int, bytes]]:
    """Number and body of every object in order, those in compressed object streams included; the last definition of a number counts."""
    for m in _OBJECT.finditer(content):
        body = m[2]
        yield int(m[1]), body
        if not re.search(rb"/Type\s*/ObjStm\b", body):
            continue
        n, first, data = re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body), _STREAM.search(body)
        if not (n and first and data):
            continue
        try:
            raw = zlib.decompressobj().decompress(data[1]) if b"/FlateDecode" in body else data[1]
        except zlib.error:
            continue
        head = [int(x) for x in raw[: int(first[1])].split()[: 2 * int(n[1])]]
        places = sorted(zip(head[1::2], head[::2], strict=False))
        for (at, own), (until, _) in zip(places, [*places[1:], (len(raw), 0)], strict=False):
            yield own, raw[int(first[1]) + at : int(first[1]) + until]


@dataclass(slots=True)
class _Facts:
    """What an object says of the page tree: its root if it is the catalog, a count or the number of the object that holds it, and its own first number."""

    root: int | None
    count: int | None
    count_at: int | None
    plain: int | None


def _number(m: re.Match | None, most: int = (1 << 31) - 1) -> int | None:
    digits = m[m.re.groups].lstrip(b"0") if m else b""
    return int(digits or 0) if m and len(digits) < 20 and int(digits or 0) <= most else None


def _facts(body: bytes) -> _Facts:
    root = re.search(rb"/Pages" + _REF, body) if b"/Catalog" in body and re.search(rb"/Type\s*/Catalog\b", body) else None
    counted = b"/Count" in body
    count = re.search(rb"/Count\s+(\d+)\b(?!\s+\d+\s+R\b)", body) if counted else None
    at = re.search(rb"/Count" + _REF, body) if counted and not count else None
    return _Facts(_number(root, _LAST), _number(count), _number(at, _LAST), _number(re.search(rb"\d+", body)))


def _begins(content: bytes) -> bool:
    return b"%PDF-" in content[:1024]


def count_pages(content: bytes | None) -> int | None:
    """The number of pages that the page tree's root states; None if there is no tree."""
    if not content or not _begins(content):
        return None
    objects = {}
    for number, body in _definitions(content):
        objects[number] = _facts(body)
    for x in reversed(list(objects.values())):
        tree = objects.get(x.root)
        if tree and tree.count is not None:
            return tree.count
        if tree and tree.count_at is not None:
            return objects[tree.count_at].plain if tree.count_at in objects else None
    return None


def _counts(c: pa.Array) -> pa.Array:
    return pa.array([count_pages(x.as_py()) for x in c], pa.int32())


def page_count(content: Column) -> Column:
    """Pages of a PDF's content, or null."""
    return F.arrow_udf(_counts, "int")(content)


_PART = "struct<begins:boolean,objects:array<struct<number:bigint,root:bigint,count:bigint,count_at:bigint,plain:bigint>>>"


def _read_part(c: pa.Array) -> pa.Array:
    kind = pa.struct([("begins", pa.bool_()), ("objects", pa.list_(pa.struct([(k, pa.int64()) for k in ("number", "root", "count", "count_at", "plain")])))])
    read = lambda x: {"begins": _begins(x), "objects": [{"number": n, "root": f.root, "count": f.count, "count_at": f.count_at, "plain": f.plain} for n, body in _definitions(x) for f in (_facts(body),)]}
    return pa.array([None if x is None else read(x.as_py()) for x in c for x in ((x if x.is_valid else None),)], kind)


def page_counts(parts: DataFrame, file: str = "path") -> DataFrame:
    """file and pages (int, or null) of files that come in parts: a row for each with file, part (its place) and content. Parts end between objects. Each is read where it is, and what
    its objects say of the page tree is joined by number, so that no file is whole in any place."""
    read = parts.select(F.struct(file).alias("_file"), "part", F.arrow_udf(_read_part, _PART)("content").alias("_p"))  # a struct, whose nulls are equal
    read = read.select("_file", "part", "_p.begins", F.posexplode_outer("_p.objects").alias("_at", "_o"))
    read = store.written(read, "objects")  # contents are read once
    files = read.groupBy("_file").agg(F.min_by("begins", F.struct("part", "_at")).alias("begins"))
    # of the definitions of a number the last counts, at the place of the first
    objects = read.where("_o is not null").groupBy("_file", "_o.number").agg(F.min(F.struct("part", "_at")).alias("first"), F.max(F.struct("part", "_at", "_o"))["_o"].alias("o"))
    catalogs = objects.where("o.root is not null").select("_file", F.col("o.root").alias("number"), F.col("first").alias("catalog"))
    trees = catalogs.join(objects, ["_file", "number"]).where("o.count is not null or o.count_at is not null")
    tree = trees.groupBy("_file").agg(F.max_by(F.struct("o.count", "o.count_at"), "catalog").alias("t"))
    held = tree.select("_file", F.col("t.count_at").alias("number")).join(objects, ["_file", "number"]).select("_file", F.col("o.plain").alias("plain"))
    found = files.join(tree, "_file", "left").join(held, "_file", "left")
    return found.select("_file.*", F.when(F.col("begins"), F.coalesce("t.count", "plain")).cast("int").alias("pages"))


@dataclass
class Share(InputPartition):
    """Part k of n of each of paths."""

    paths: tuple[str, ...]
    k: int = 0
    n: int = 1


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return "path string, pages int, page_number int, content binary, error string"

    def reader(self, schema) -> PdfReader:
        return PdfReader(self.options)


class PdfReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.decoder = options.get("decoder")
        self.zoom = float(options.get("zoom", 2.0))

    def partitions(self) -> list[Share]:
        store, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        info = store.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(".pdf"))
        out: list[Share] = []
        group, held = [], 0
        for path, size in files:
            if size > self.split_bytes:
                n = -(-size // self.split_bytes)
                out += [Share((path,), k, n) for k in range(n)]
                continue
            if group and held + size > self.split_bytes:
                out.append(Share(tuple(group)))
                group, held = [], 0
            group.append(path)
            held += size
        return [*out, Share(tuple(group))] if group or not out else out

    def read(self, partition: Share) -> Iterator[tuple]:
        store = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else pafs.LocalFileSystem()
        decode = None
        if self.decoder:
            module, _, name = self.decoder.partition(":")
            decode = getattr(importlib.import_module(module), name)
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                content = f.read()
            pages = count_pages(content)
            if pages is None:
                if partition.k == 0:
                    yield path, None, None, None, "no page tree"
                continue
            wanted = range(pages * partition.k // partition.n + 1, pages * (partition.k + 1) // partition.n + 1)
            try:
                images = iter(decode(content, self.zoom, wanted)) if decode else (None for _ in wanted)
                for number, image in zip(wanted, images, strict=True):
                    yield path, pages, number, image, None
            except Exception as e:  # noqa: BLE001  a file that can't be rendered is reported, not fatal
                yield path, pages, None, None, str(e) or type(e).__name__
