"""Pages of generated PDF files."""

from __future__ import annotations

import zlib

import pytest

from pagewright.sources import pdf


def plain(n: int, extra: bytes = b"") -> bytes:
    kids = b" ".join(b"%d 0 R" % (3 + k) for k in range(n))
    pages = b"".join(b"%d 0 obj\n<< /Type /Page /Parent 2 0 R >>\nendobj\n" % (3 + k) for k in range(n))
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [" + kids + b"] /Count %d >>\nendobj\n" % n + pages + extra + b"trailer << /Root 1 0 R >>\n%%EOF"


def compressed(n: int) -> bytes:
    """Catalog and page tree in an object stream."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [] /Count %d >>" % n]
    body = objects[0] + b" " + objects[1]
    head = b"1 0 2 %d " % (len(objects[0]) + 1)
    data = zlib.compress(head + body)
    return b"%PDF-1.5\n9 0 obj\n<< /Type /ObjStm /N 2 /First " + b"%d" % len(head) + b" /Filter /FlateDecode /Length " + b"%d" % len(data) + b" >>\nstream\n" + data + b"\nendstream\nendobj\n%%EOF"


def updated(a: int, b: int) -> bytes:
    """An incremental update redefines the page tree."""
    return plain(a) + b"\n2 0 obj\n<< /Type /Pages /Kids [] /Count %d >>\nendobj\n%%%%EOF" % b


@pytest.mark.parametrize(("content", "pages"), [(plain(3), 3), (plain(0), 0), (compressed(17), 17), (updated(3, 5), 5), (b"", None), (None, None), (b"no pdf /Count 3", None), (b"%PDF-1.4 nothing", None), (plain(2).replace(b"/Count 2", b"/Count 77 0 R") + b"\n77 0 obj 2 endobj", 2)])
def test_count(content, pages):
    assert pdf.count_pages(content) == pages


def images(content: bytes, zoom: float, wanted):
    if b"broken" in content:
        raise ValueError("broken")
    for n in wanted:
        yield b"%d at %d" % (n, int(zoom))


def test_data_source(spark, tmp_path, monkeypatch):
    files = {"a.pdf": plain(3), "deep/b.PDF": compressed(2), "big.pdf": plain(40, b"x" * 5_000), "bad.pdf": b"not a pdf", "c.txt": plain(9), "broken.pdf": plain(2, b"broken")}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    spark.dataSource.register(pdf.PdfPages)
    got = spark.read.format("pdf_pages").option("split_bytes", "1000").load(str(tmp_path)).collect()
    rows = sorted((r["path"].split("/")[-1], r["page_number"]) for r in got if r["error"] is None)
    assert rows == sorted([*(("a.pdf", k) for k in (1, 2, 3)), *(("b.PDF", k) for k in (1, 2)), *(("big.pdf", k) for k in range(1, 41)), *(("broken.pdf", k) for k in (1, 2))])
    assert [(r["path"].split("/")[-1], r["error"]) for r in got if r["error"]] == [("bad.pdf", "no page tree")]
    assert all(r["content"] is None for r in got)
    shares = pdf.PdfReader({"path": str(tmp_path), "split_bytes": "1000"}).partitions()
    big = [s for s in shares if s.paths[0].endswith("big.pdf")]
    assert len(big) >= 5 and all(len(s.paths) == 1 for s in big) and sum(len(s.paths) for s in shares if s.n == 1) == 4
    reader = pdf.PdfReader({"path": f"file://{tmp_path}", "decoder": f"{__name__}:images", "zoom": "3"})
    read = [row for s in reader.partitions() for row in reader.read(s)]
    assert sorted(r[3] for r in read if r[3] and r[0].endswith("a.pdf")) == [b"1 at 3", b"2 at 3", b"3 at 3"]
    assert [r[4] for r in read if r[0].endswith("broken.pdf")] == ["broken"]


def test_empty_folder(spark, tmp_path):
    spark.dataSource.register(pdf.PdfPages)
    assert spark.read.format("pdf_pages").load(str(tmp_path)).collect() == []


def test_counts_of_parts(spark):
    """Files in parts have the same pages as whole ones, the last definition of an object counts wherever it is, and no part of a file meets another."""
    whole = {"plain": plain(3), "none": plain(0), "packed": compressed(17), "updated": updated(3, 5), "held": plain(2).replace(b"/Count 2", b"/Count 77 0 R") + b"\n77 0 obj 2 endobj", "lost": plain(2).replace(b"/Count 2", b"/Count 78 0 R"), "other": b"no pdf 1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", "bare": b"%PDF-1.4 nothing", "gone": plain(4) + b"\n2 0 obj << /Type /Page >> endobj", None: plain(6)}
    rows = [(name, n, x) for name, content in whole.items() for n, x in enumerate(content.replace(b"endobj", b"endobj\0").split(b"\0") if name != "packed" else [content])]
    assert len(rows) > 30
    parts = spark.createDataFrame([*rows, ("empty", 0, None)], "path string, part int, content binary").repartition(7)
    found = pdf.page_counts(parts)
    got = {r["path"]: r["pages"] for r in found.collect()}
    assert got == {name: pdf.count_pages(content) for name, content in whole.items()} | {"empty": None}
    assert got["updated"] == 5 and got["held"] == 2 and got[None] == 6 and got["gone"] is None and got["lost"] is None
    assert "collect_list" not in found._jdf.queryExecution().toString()
