"""Operators 9 and 10, and the pipeline."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagewright.llm import html_text, warc
from pagewright.llm._common import stage_path

PAGES = "page_id long, url string, html string, record_type string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "same " * 60 + "</p>"
    rows = [(5, "http://a/1", big), (3, "http://b/2", big), (9, None, big), (1, "http://c/\n3", "tiny"), (2, "http://d/4", "tiny"), (7, "http://e", None), (8, "", ""), (3, "http://b/2", big), (None, "http://f", big), (10, "http://g", "é" * 60), (11, "http://g", "é" * 60), (12, "http://h", "x" * 200_000)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGES)


def test_warc_round_trip(spark, pages):
    folder = stage_path(spark, "warc-test")
    parts = warc.write_archives(pages, folder, warc.WarcParams(part_bytes=4096))
    got = warc.resolve_revisits(warc.read_archives(spark, folder, parts)).collect()
    rows = pages.collect()
    assert len(got) == len(rows)
    known = {(r["page_id"], hashlib.sha256((r["html"] or "").encode()).hexdigest(), len((r["html"] or "").encode())) for r in rows}
    assert {(r["page_id"], r["payload_digest"], r["payload_bytes"]) for r in got} == known
    for r in got:
        same = [x["page_id"] for x in rows if hashlib.sha256((x["html"] or "").encode()).hexdigest() == r["payload_digest"] and x["page_id"] is not None]
        if r["record_type"] == "revisit":
            assert r["payload_bytes"] >= 100 and r["refers_to"] == min(same)
        else:
            assert r["refers_to"] is None and (r["payload_bytes"] < 100 or r["page_id"] == min(same))
    assert sum(r["record_type"] == "response" and r["payload_bytes"] >= 100 for r in got) == 3
    empty = pages.where("false")
    folder = stage_path(spark, "warc-test")
    assert warc.read_archives(spark, folder, warc.write_archives(empty, folder)).collect() == []


def test_attempts_that_cut_other_parts(spark, pages):
    """Two attempts in one folder, their rows in another order: each reading is whole."""
    folder = stage_path(spark, "warc-test")
    both = [warc.write_archives(pages.orderBy(order).coalesce(1), folder, warc.WarcParams(part_bytes=500)) for order in (F.col("page_id"), F.desc("page_id"))]
    names = [[r["name"] for r in parts.collect()] for parts in both]
    assert len(names[0]) > 1 and not set(names[0]) & set(names[1])
    first, second = (Counter(map(tuple, warc.resolve_revisits(warc.read_archives(spark, folder, parts)).collect())) for parts in both)
    assert first == second and first.total() == pages.count()


def test_truncated_archive():
    record = warc.encode("response", "<urn:uuid:1>", "1", "http://a", "d", b"payload", None, None, warc.WarcParams())
    assert [p for _, p in warc.decode(record + record)] == [b"payload", b"payload"]
    with pytest.raises(ValueError):
        list(warc.decode(record[:-9]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div><!-- x --><div id="cookie-notice">Cookies!</div>
<main><article class="post no-sidebar"><h1>Title &amp; more</h1><p>First  <b>bold</b>para&shy;graph&nbsp;one<br>two.<p>Second <a href="#">link</a>.
<aside>Side</aside><form><p>Name</p></form><div class="share-buttons social">Share</div><ul><li>a<li>b</ul><section class="comments"><p>Nice!</p></section>
<table><tr><td>x<td>y</table></article></main><footer>&copy; me</footer></body></html>"""


def test_main_text():
    got = html_text.main_text(PAGE)
    assert got == "Title & more First boldpara­graph one two. Second link . a b x y".replace("link .", "link.")
    assert html_text.main_text("") == ""
    assert html_text.main_text("<p>a &lt; b") == "a < b"
    assert html_text.main_text("<article><p>one<script>x") == "one"
    assert html_text.main_text("<body><ul><li><a>Home</a><li><a>News</a></ul><div><p>Some text of the page.</p></div>") == "Some text of the page."


def test_tree_matching():
    a, b = html_text.parse("<div><p>x</p><ul><li>1<li>2</ul></div>"), html_text.parse("<div><p>y</p><hr><p>z</p><ul><li>1</ul></div>")
    size, pairs = html_text.simple_tree_matching(a, b)
    assert size == 5 == len(pairs)


def brute_matching(a, b):
    """The textbook recursion, for small trees."""
    if a.key() != b.key():
        return 0
    x, y = a.nodes(), b.nodes()
    m = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, c in enumerate(x, 1):
        for j, d in enumerate(y, 1):
            m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + brute_matching(c, d))
    return m[-1][-1] + 1


def test_tree_matching_by_brute_force():
    import random

    r = random.Random(4)

    def tree(depth):
        node = html_text.Node(r.choice("ab") if depth else "html", {})
        node.children = [tree(depth + 1) for _ in range(r.randrange(5 if depth < 4 else 1))]
        return node

    for _ in range(150):
        a, b = tree(0), tree(0)
        size, pairs = html_text.simple_tree_matching(a, b)
        assert size == brute_matching(a, b) == len(pairs)
        of = {id(x): y for x, y in pairs}
        above = lambda root: {id(c): n for n, _, _ in html_text._placed(root) for c in n.nodes()}
        up, vp = above(a), above(b)
        for x, y in pairs:  # same keys, matched parents, order kept
            assert x.key() == y.key() and (x is a or of[id(up[id(x)])] is vp[id(y)])
        for n, _, _ in html_text._placed(a):
            own = [of[id(c)] for c in n.nodes() if id(c) in of]
            if own:
                at = [[id(z) for z in vp[id(own[0])].nodes()].index(id(y)) for y in own]
                assert at == sorted(at)
    many = lambda k: html_text.parse("<ul>" + "".join(f"<li>{i}</li><li class={'x' if i % k else 'y'}>{i}</li>" for i in range(60)) + "</ul>")
    a, b = many(3), many(4)
    shapes = html_text._Shapes()
    p, q = (t.nodes()[0].nodes() for t in (a, b))
    of = shapes.add(a) | shapes.add(b)
    table = shapes.table(tuple(of[id(n)] for n in p), tuple(of[id(n)] for n in q))
    whole, halved = html_text._aligned(table), html_text._aligned(table, most=50)
    assert len(whole) == len(halved) == html_text.simple_tree_matching(a, b)[0] - 2


def test_deep_and_long_pages(spark):
    deep = ["<div>" * 10_000 + f"story {k}" + "</div>" * 10_000 for k in range(5)]
    assert html_text.main_text(deep[0]) == "story 0"
    assert html_text.induce(deep).path == ("div",) * 10_000
    long = ["<div class=top>Fixed words here</div><div id=x><ul>" + "".join(f"<li>item {i * k} of {k}</li>" for i in range(1000 + k)) + "</ul></div>" for k in range(1, 6)]
    rows = [(k, "http://long.example/", h) for k, h in enumerate(long)] + [(100 + k, "http://deep.example/", h) for k, h in enumerate(deep)]
    got = {r["page_id"]: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(5):
        assert got[k]["text"] == " ".join(f"item {i * (k + 1)} of {k + 1}" for i in range(1001 + k)) and got[k]["by_wrapper"]
        assert got[100 + k]["text"] == f"story {k}"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p class="x>Hello</p><p>World</p>', "Hello World"),
        ('<p class="x>Hello</p><p class="y">World</p>', "Hello World"),
        ("<p title='it>Hello</p><p>World's</p>", "Hello World's"),
        ('<p title="a > b">Hello</p>', "Hello"),
        ('<div id="a"class="b"><p>Hello</p></div>', "Hello"),
        ('<script src="x>var a=1;</script><p>Hello', "Hello"),
        ("<p>Hello <b", "Hello"),
    ],
)
def test_broken_quotes(html, text):
    assert html_text.main_text(html) == text


def test_class_words_need_support():
    inside = '<article><p>A</p><div class="legal-text">B</div><table class="form"><tr><td>C</table><p class="notice">D</p><div class="search">no</div><div class="ad-box">no</div></article>'
    assert html_text.main_text(inside) == "A B C D"
    assert html_text.main_text('<div class="legal-text">no</div><p>A</p>') == "A"


def test_slots_choose_the_content(spark):
    """Pages without semantic tags: menu, advert and imprint vary as the article does, and no class tells which is which."""
    word = lambda k, n: " ".join(f"w{(k * 31 + i * 7) % 97}" for i in range(n))
    page = lambda k: (
        f'<body><div class="a1"><ul><li><a href="/{k}">{word(k, 3)}</a></li></ul></div><div class="b{k}"><p>{word(k + 5, 4)}</p></div><div class="c3"><div class="d4"><h1>{word(k, 5)}</h1>'
        f"<p>{word(k + 1, 60 + k)}</p><p>Read on below</p><p>{word(k + 2, 40)}</p></div></div><div>{word(k + 9, 5)}</div></body>"
    )
    want = lambda k: f"{word(k, 5)} {word(k + 1, 60 + k)} {word(k + 2, 40)}"
    other = lambda k: f'<body><div class="c3"><p>{word(k, 30)}</p></div><div id="z"><p>{word(k, 80)}</p></div></body>'
    rows = [(k, "http://plain.example/a", page(k), "clash") for k in range(12)] + [(3, "http://plain.example/a", page(3), "clash")]
    rows += [(50 + k, "http://plain.example/b", other(k), "clash") for k in range(6)] + [(90, "http://alone.example/", page(90), "clash")]
    got = {r["page_id"]: r for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert len(got) == 19
    for k in range(12):
        assert got[k]["text"] == want(k) and got[k]["by_wrapper"]
    for k in range(6):  # another layout has a wrapper of its own: no single container has most of the text
        assert got[50 + k]["text"].endswith(word(k, 80))
    assert got[90]["text"].startswith(word(95, 4)) and not got[90]["by_wrapper"]


def test_wrapper(spark):
    page = lambda k: f"<body><div><p>Subscribe now for news</p></div><div><p>Story number {k} about thing {k * 7}</p></div><div>Imprint</div></body>"
    rows = [(k, f"http://host.example/{k}", page(k)) for k in range(9)] + [(20, "no url", page(20)), (21, None, page(21)), (22, "http://other.example/", None)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 about thing 21"
    assert got[20].startswith("Subscribe") and got[22] == ""
    assert len(got) == 12


def test_copies_are_no_template(spark):
    page = lambda k, n=0: f"<body><script>var n={n};</script><div><p>Subscribe now for news</p></div><div><p>Story number {k} about thing {k * 7}</p></div><div>Imprint</div></body>"
    rows = [(k, "http://copies.example/", page(1)) for k in range(9)]
    rows += [(100 + k, f"http://most.example/{k}", page(1, k)) for k in range(60)] + [(200 + k, f"http://most.example/o{k}", page(k)) for k in range(2, 7)]
    rows += [(300, "http://repeated.example/", page(1))] * 20 + [(None, "http://repeated.example/", page(1))]
    got = [(r["page_id"], r["text"]) for r in html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    assert len(got) == len(rows)
    for k, text in got:
        if k is None or k < 100 or k == 300:
            assert text == "Subscribe now for news Story number 1 about thing 7 Imprint"
        else:
            assert text == (f"Story number {k - 200} about thing {(k - 200) * 7}" if k >= 200 else "Story number 1 about thing 7")


def test_extraction_fixture(spark, small):
    import html
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in html_text.extract_main_text(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        text = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article))).split())
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
    assert sum(r["by_wrapper"] for r in got.values()) > 0
    assert html_text.extract_main_text(pages.where("false")).collect() == []


def test_pipeline(spark, small):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{small}/documents.parquet")
    ids = {r["doc_id"] for r in docs.collect()}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        now = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert now <= ids
        ids, docs = now, spark.createDataFrame(out.collect(), out.schema)
    assert len(ids) > 100
    assert {r["doc_id"] for r in P.run(spark, small).collect()} == ids


def test_pipeline_on_awkward_rows(spark, docs, no_docs, small):
    """Every stage on nulls, empty and very long texts, ties, repeated rows and clashing columns, and on an empty table."""
    import corpus_pipeline as P

    now = docs
    for name, stage in P.STAGES[:-1]:
        before = [r["doc_id"] for r in now.collect()]
        out = stage(spark, now, small)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert not Counter(r["doc_id"] for r in rows) - Counter(before), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows if r["text"] is not None), name
        now = spark.createDataFrame(rows, out.schema)
        empty = stage(spark, no_docs, small)
        assert empty.columns == docs.columns and empty.collect() == [], name
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    assert {1, 7, 8, 9} <= set(kept) and not {2, 3, 4, 5, 6, 10} & set(kept)
    passage = " ".join(docs.where("doc_id = 8").first()["text"].split()[60:180])
    assert all(passage not in " ".join(t.split()) for t in kept.values())
    assert {r["doc_id"] for r in P.mix_sources(spark, now, small).collect()} == set(kept)
    assert P.mix_sources(spark, no_docs, small).collect() == []


def test_registry():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(e.oracle_sql()) <= names


INSIDE = [
    ('<div class="cookie-recipe">Mix flour</div>', "Mix flour"),
    ('<div class="promo-code">abc</div>', "abc"),
    ('<ul class="menu-items"><li>Soup</ul>', "Soup"),
    ("<p><label>inline</label> text</p>", "inline text"),
    ('<section class="user-reviews"><p>Liked it</p></section>', ""),
    ('<div class="cookie-banner">Yes?</div>', ""),
    ('<div id="adSlot3">Buy</div>', ""),
    ('<div class="share-buttons">Share</div>', ""),
    ('<div class="related-posts">More</div>', ""),
    ('<div class="legal-text">Law</div>', "Law"),
    ('<div class="article-comments">First!</div>', ""),
    ("<form><label>Name</label></form>", ""),
]


@pytest.mark.parametrize(("part", "text"), INSIDE)
def test_names_within_an_article(part, text):
    assert html_text.main_text(f"<article><p>Before.</p>{part}<p>After.</p></article>") == " ".join(["Before.", *text.split(), "After."])


def test_names_within_a_region(spark):
    """Without article tags, the wrapper's region counts: what varies in it stays, what is the same goes, and so do names that say so whole."""
    page = lambda k: (
        f'<body><div class="nav"><a href="/">Home</a></div><div class="story"><h1>Head {k}</h1><p>{f"Words of page {k} and more. " * 9}</p><div class="cookie-recipe">Mix {k} cups</div>'
        f'<div class="promo-code">code {k}</div><div class="ad">Buy {k}</div><ul class="menu-items"><li>Soup {k}</ul><div class="tail-box">The same on every page.</div></div><div class="foot">Firm</div></body>'
    )
    rows = [(k, f"http://h/{k}", page(k)) for k in range(9)]
    got = html_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        k = r["page_id"]
        assert r["by_wrapper"] and r["text"] == " ".join(f"Head {k} {f'Words of page {k} and more. ' * 9} Mix {k} cups code {k} Soup {k}".split())


def test_tagless_copies(spark, small):
    """Pages with other tags and class names in place of the telling ones give the same texts."""
    pages = spark.read.parquet(f"{small}/pages.parquet").where("html is not null")
    html = F.col("html")
    for a, b in (("article", 'div class="k1"'), ("nav", 'div class="k2"'), ("footer", 'div class="k3"')):
        html = F.regexp_replace(F.regexp_replace(html, f"<{a}\\b[^>]*>", f"<{b}>"), f"</{a}>", "</div>")
    html = F.regexp_replace(html, 'class="ad"', 'class="k4"')
    want = {r["page_id"]: r["text"] for r in html_text.extract_main_text(pages).collect()}
    got = {r["page_id"]: r for r in html_text.extract_main_text(pages.withColumn("html", html)).collect()}
    by = [k for k, r in got.items() if r["by_wrapper"]]
    same = sum(got[k]["text"] == want[k] for k in by)
    assert len(by) >= 0.9 * len(want) and same >= 0.97 * len(by)


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_hosts_of_one_page_with_containers_alike(spark, most):
    """Each host has one page, and no tag or class name tells the content from the rest; the parts of a story all stay."""
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    kinds = {
        "divs": ('<div class="k1">{0}</div><div class="k2"><h1>Head {2}</h1><p>{1}</p></div><div class="k3">{0} end</div>', False),
        "cells": ('<table><tr><td>{0}</td><td><h1>Head {2}</h1><p>{1}</p></td><td>{0} end</td></tr></table>', False),
        "parts": ('<div class="story"><div class="p1"><h1>Head {2}</h1><p>{1}</p></div><div class="p2">{0}</div></div>', True),
    }
    rows = [(f"{kind}{k}", f"http://{kind}{k}.org/x" if k else None, f"<html><body>{html.format(words(k, 4), words(k + 100, 40), k)}</body></html>") for kind, (html, _) in kinds.items() for k in range(7)]
    rows.append(("lacks7", "http://lacks.org/x", f'<html><body><div class="k1"><h1>Head 7</h1><p>{words(107, 40)}</p></div><div class="k2">end</div></body></html>'))
    docs = spark.createDataFrame([(n, *r[1:]) for n, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract_main_text(docs, html_text.HtmlParams(broadcast_nodes=most)).collect()}
    assert len(got) == len(rows)
    assert (got[21]["by_wrapper"], got[21]["text"]) == (False, f"Head 7 {words(107, 40)} end")
    for n, (name, url, _) in enumerate(rows[:21]):
        k = int(name[-1])
        own, story = f"Head {k} {words(k + 100, 40)}", kinds[name[:-1]][1]
        assert got[n]["by_wrapper"] == (url is not None)
        if url:
            assert got[n]["text"] == (f"{own} {words(k, 4)}" if story else own)


@pytest.mark.parametrize("most", [0, 4_000_000])
def test_wrappers_by_broadcast_and_shuffle(spark, small, most):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    p = html_text.HtmlParams(broadcast_nodes=most)
    assert Counter(map(tuple, html_text.extract_main_text(pages, p).collect())) == Counter(map(tuple, html_text.extract_main_text(pages).collect()))


def test_hot_payload(spark):
    """One payload for nine tenths of the pages: every page is there once, all but the first revisit it."""
    error = "<html><body>Not found. " + "Sorry. " * 30 + "</body></html>"
    rows = [(k, f"http://a/{k}", error if k % 10 else f"{error}{k}", "x") for k in range(1, 2001)]
    folder = stage_path(spark, "warc-test")
    parts = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(7), folder, warc.WarcParams(part_bytes=1 << 14))
    got = {r["page_id"]: r for r in warc.resolve_revisits(warc.read_archives(spark, folder, parts)).collect()}
    assert len(got) == 2000
    assert all((r["record_type"], r["refers_to"]) == (("revisit", 1) if k % 10 and k > 1 else ("response", None)) for k, r in got.items())
