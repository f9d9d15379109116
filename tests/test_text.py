"""Golden cases of cleanup, tokens and classification."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("magne-\ntism", "magnetism"),
        ("a\n 12 \nb", "a\n\nb"),
        ("1295.1 Intro", "5.1 Intro"),
        ("M AGNETISM", "MAGNETISM"),
        ("5.1 M AGNETISM", "5.1 MAGNETISM"),
        ("FIGFIGFIG 2", "FIG 2"),
        ("the the the cat cat", "the cat cat"),
        ("“quoted” – text…", '"quoted" - text...'),
        ("ﬁeld ½", "field 1⁄2"),
        ("", ""),
        (None, ""),
    ],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text(F.lit(raw).cast("string"))) == clean


def runs(line):
    out, tokens, i = [], line.split(" "), 0
    while i < len(tokens):
        j = i
        while j + 1 < len(tokens) and tokens[j + 1] == tokens[i] != "":
            j += 1
        out += tokens[i : i + 1] if j - i >= 2 else tokens[i : j + 1]
        i = j + 1
    return " ".join(out)


@pytest.mark.parametrize("line", ["a a a", "a a b b b b a", "x  x x x ", "", "b b", "a a a a a b a a a"])
def test_token_runs(spark, line):
    assert one(spark, T.collapse_token_runs(F.lit(line))) == runs(line)


@pytest.mark.parametrize(
    ("query", "kind"),
    [
        ("What is the formula for magnetic flux density?", "formula"),
        ("derive Coulomb's law", "derivation"),
        ("compare diamagnetic and paramagnetic materials", "table"),
        ("explain everything in chapter 5", "general"),
        ("what is the formula?", "general"),
        ("give an overview of the data table", "comprehensive"),
        ("list the proof steps", "derivation"),
    ],
)
def test_query_type(spark, query, kind):
    assert one(spark, T.query_type(F.lit(query))) == kind


def test_tokens(spark):
    assert one(spark, T.section_numbers(F.lit("see 5.1 and 5.2.3"))) == ["5.1", "5.2.3"]
    assert one(spark, T.section_numbers(F.lit("chapter 5"))) == []
    assert one(spark, T.section_numbers(F.lit("1.2.3.4.5"))) == ["1.2.3.4"]
    assert one(spark, T.content_tokens(F.lit("Explain the bar magnet's field and bar magnets"))) == ["bar", "magnet's", "field", "magnets"]
    assert one(spark, T.ordered_distinct(F.array(*[F.lit(x) for x in ["A", "b", " a", "", "B ", "c"]]))) == ["A", "b", "c"]


@pytest.mark.parametrize(
    ("text", "title"),
    [("5.1 MAGNETS AND FIELDS\nrest", "5.1 MAGNETS AND FIELDS"), ("  6 NEW\nrest", None), ("text\n5.1 MAGNETS\n", None), ("7 LAWS", "7 LAWS"), (None, None)],
)
def test_leading_heading(spark, text, title):
    got = one(spark, T.leading_heading(F.lit(text).cast("string")))
    assert (got and got["title"]) == title


def test_running_header(spark):
    text = "HEADER\na\n header\nHeader\nb"
    assert one(spark, T.strip_running_header(F.lit(text), F.lit("Header"))) == "HEADER\na\n header\nb"


def test_ordered_distinct_of_white_space_and_repeats(spark):
    """White space of every kind is trimmed; the first spelling stays, however often others come."""
    white = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
    assert T.WHITE == white
    words = ["", None, "B", f"{white}b{white}", "a", "A", "B", white, "a", "ä ", "Ä"]
    row = spark.createDataFrame([(words,)], "w array<string>").select(T.ordered_distinct(F.col("w")).alias("o")).first()
    assert row["o"] == ["B", "a", "ä"]


def test_terms_are_runs_of_letters_and_digits(spark):
    texts = [None, "", " ,.", "One,two  3x", ".a.", "Ünder_score"]
    found = [r["w"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.terms(F.col("t")).alias("w")).collect()]
    assert found == [[], [], [], ["one", "two", "3x"], ["a"], ["nder", "score"]]


def test_cheap_steps_give_the_same(spark):
    """Runs of tokens by one pattern as token by token, on random lines and a run too long for a stack; trimming as the pattern of white space does."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "ab", "b", " ", " ", "\n", "é", "\t", "a a a ", "a "]) for _ in range(r.randrange(30))) for _ in range(1500)]
    texts += ["x " * 30_000 + "xy", "a a a", "a a a\na a a", "aa a a ab", "a a a ab", None, ""] + [w + "a" + w + "b" + w for w in T.WHITE] + list(T.WHITE) + ["​a​", "﻿a"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    by_token = T.each_line(F.col("t"), T.collapse_token_runs)
    by_pattern = F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "")
    plain = F.replace(F.translate("t", T.PUNCTUATION_FROM, T.PUNCTUATION_TO), F.lit(T.ELLIPSIS), F.lit("..."))
    for got, want in ((T.collapse_runs_by_line, by_token), (T.strip, by_pattern), (T.map_punctuation, plain)):
        assert d.select("t", got(F.col("t")).alias("got"), want.alias("want")).where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_no_splitter_needs_no_worker(spark):
    """Without a splitter, prose isn't sent to Python."""
    from pagewright.operators import chunks

    pages = spark.createDataFrame([("d", n, "word " * 300) for n in (1, 2, 3)], "document_id string, page_number int, text string")
    leaves = spark.createDataFrame([("d", 0, "n0", "T", "1", 1, 3, "")], "document_id string, leaf_pos int, node_id string, title string, section_id string, start_index int, end_index int, summary string")
    for c in ("formulas", "tables", "keywords"):
        pages = pages.withColumn(c, F.lit(None).cast(chunks.PAGE_FIELDS[c]))
    parents = chunks.assemble_parents(pages, leaves, normalize=False)
    workers = lambda df: df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")
    assert workers(chunks.split_parents(parents)) == workers(parents)
    assert workers(chunks.split_parents(parents, lambda prose, title: [])) > workers(parents)
