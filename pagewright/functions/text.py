"""Text cleanup, tokens and query classification as Column expressions (the only Python step is NFKC, for texts that need it)."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation map of the cleanup chain.
PUNCTUATION_FROM = "‘’“”–— "
PUNCTUATION_TO = "''\"\"-- "
ELLIPSIS = "…"

# Query vocabularies.
STOP_WORDS = (
    "the and for with that this from into onto about are was were has have had been its out over under between among what which why how when where who does did doing "
    "explain define definition describe discuss example examples"
).split()
FORMULA_WORDS = "formula equation derive derivation proof calculate compute solve integral differential theorem lemma expression".split()
TABLE_WORDS = "table comparison compare list values properties data chart".split()
DERIVATION_WORDS = "derive derivation step-by-step steps proof prove".split()
COMPREHENSIVE_PHRASES = (
    "explain in depth",
    "explain in detail",
    "cover all",
    "all key concepts",
    "key concepts",
    "key theorems",
    "worked examples",
    "in depth",
    "in detail",
    "everything about",
    "complete overview",
    "full explanation",
    "overview of",
)
QUERY_TYPES = ("comprehensive", "derivation", "formula", "table", "general")

# Patterns of the cleanup chain, in its order.
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
HYPHEN_BREAK = r"(?U)(\w)-\s*\n\s*(?=[a-z])"
PAGE_NUMBER_LINE = r"(?mdU)^\s*\d{1,4}\s*$"
GLUED_PAGE_NUMBER = r"(?mdU)^(\d{2,4})(?=\d+\.\d+)"
MANY_NEWLINES = r"\n{3,}"
MANY_SPACES = r"[ \t]{2,}"
TOKEN_RUN = r"(?<![^ \n])([^ \n]++)(?: \1(?![^ \n])){2,}+"  # collapse_token_runs() on every line; possessive, so that long runs need no stack
CAPS_STUTTER = r"([A-Z]{2,10})\1{2,}"
LETTER_GAP = r"(?mdU)^((?:\d+(?:\.\d+)+\s+)?)([A-Z])\s+(?=[A-Z]{2,}\b)"
TITLE_GAP = r"(?U)^([A-Z])\s+(?=[A-Z]{2,}\b)"

# Patterns of section numbers, content tokens and leading headings.
SECTION_NUMBER = r"\b(\d+(?:\.\d+){1,3})\b"
CONTENT_TOKEN = r"[a-z][a-z\-']{2,}"
HEADING = r"(?d)\A(\d+(?:\.\d+){0,3})\s+([A-Z][A-Z0-9\s'&,\-()]{3,}?)(?:\n|\z)"


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    """The rule that an empty string counts as absent."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[blank_to_null(c) for c in columns], F.lit(""))


#: What strip() takes for white space (Unicode's White_Space).
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def _nfkc(c: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in c.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """NFKC; ASCII texts don't leave the JVM."""
    return F.coalesce(F.arrow_udf(_nfkc, "string")(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def map_punctuation(c: Column) -> Column:
    pairs = [*zip(PUNCTUATION_FROM, PUNCTUATION_TO, strict=True), (ELLIPSIS, "...")]
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)  # a search of bytes each; translate() looks at every character


def drop_control(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def join_hyphen_breaks(c: Column) -> Column:
    return F.regexp_replace(c, HYPHEN_BREAK, "$1")


def blank_page_number_lines(c: Column) -> Column:
    return F.regexp_replace(c, PAGE_NUMBER_LINE, "")


def cut_glued_page_numbers(c: Column) -> Column:
    return F.regexp_replace(c, GLUED_PAGE_NUMBER, "")


def squeeze_newlines(c: Column) -> Column:
    return F.regexp_replace(c, MANY_NEWLINES, "\n\n")


def squeeze_spaces(c: Column) -> Column:
    return F.regexp_replace(c, MANY_SPACES, " ")


def each_line(c: Column, body) -> Column:
    return F.array_join(F.transform(F.split(c, "\n"), body), "\n")


def strip_lines(c: Column) -> Column:
    return each_line(c, strip)


def drop_caps_stutter(c: Column) -> Column:
    return F.regexp_replace(c, CAPS_STUTTER, "$1")


def collapse_token_runs(line: Column) -> Column:
    """Runs of three or more equal tokens become one; a token goes if the one before is equal and the run has a third."""

    def body(tokens: Column) -> Column:
        same = lambda t, i: F.coalesce(F.get(tokens, i) == t, F.lit(False))
        return F.array_join(F.filter(tokens, lambda t, i: ~((t != "") & same(t, i - 1) & (same(t, i + 1) | same(t, i - 2)))), " ")

    return let(F.split(line, " "), body)


def collapse_runs_by_line(c: Column) -> Column:
    return F.regexp_replace(c, TOKEN_RUN, "$1")


def close_letter_gaps(c: Column) -> Column:
    return F.regexp_replace(c, LETTER_GAP, "$1$2")


CHAIN = (
    map_punctuation,
    drop_control,
    join_hyphen_breaks,
    blank_page_number_lines,
    cut_glued_page_numbers,
    squeeze_newlines,
    squeeze_spaces,
    strip_lines,
    drop_caps_stutter,
    collapse_runs_by_line,
    close_letter_gaps,
    strip,
)


def clean_text(c: Column, normalize: bool = True) -> Column:
    """The whole cleanup chain; null and empty give an empty text. normalize=False leaves NFKC out."""
    start = nfkc(c) if normalize else c
    return F.coalesce(reduce(lambda x, step: step(x), CHAIN, start), F.lit(""))


def clean_title(c: Column, normalize: bool = True) -> Column:
    gap = F.regexp_replace(clean_text(c, normalize), TITLE_GAP, "$1")
    return strip(F.regexp_replace(gap, r"(?U)\s+", " "))


def strip_running_header(text: Column, header: Column, min_hits: int = 2) -> Column:
    """Lines equal to the header, but for case and outer white space, stay min_hits times."""
    probe = F.lower(strip(header))

    def body(lines: Column) -> Column:
        hits = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(strip(x)) == probe, i)), lambda i: i.isNotNull())
        last = lambda places: F.coalesce(F.get(places, F.lit(min_hits - 1)), F.size(lines))  # noqa: E731  that of the last one to stay
        return let(let(hits, last), lambda n: F.array_join(F.filter(lines, lambda x, i: (F.lower(strip(x)) != probe) | (i <= n)), "\n"))

    return F.when((text == "") | (F.coalesce(probe, F.lit("")) == ""), text).otherwise(let(F.split(text, "\n"), body))


def section_numbers(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SECTION_NUMBER), F.lit(1))


def content_tokens(c: Column) -> Column:
    """Words of three or more letters that carry content, first occurrence only."""
    noise = F.array(*[F.lit(w) for w in dict.fromkeys([*STOP_WORDS, *FORMULA_WORDS, *TABLE_WORDS])])
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(CONTENT_TOKEN), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: ~F.array_contains(noise, w)))


def query_type(c: Column) -> Column:
    """comprehensive, derivation, formula, table or general; words are split at white space only."""
    low = F.lower(F.coalesce(c, F.lit("")))
    words = F.split(low, r"\s+")
    has = lambda vocabulary: F.arrays_overlap(words, F.array(*[F.lit(w) for w in vocabulary]))
    phrase = reduce(lambda a, b: a | b, [low.contains(p) for p in COMPREHENSIVE_PHRASES])
    return F.when(phrase, "comprehensive").when(has(DERIVATION_WORDS), "derivation").when(has(FORMULA_WORDS), "formula").when(has(TABLE_WORDS), "table").otherwise("general")


def terms(c: Column) -> Column:
    """The plain analyzer: runs of ASCII letters and digits, lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), "")  # half the time of regexp_extract_all


def ordered_distinct(words: Column) -> Column:
    """Trimmed words, one of each that differ in case only: the first spelling, in order."""

    def body(ordered: Column) -> Column:  # by spelling and place: the first of each spelling follows another one
        first = F.filter(ordered, lambda e, j: F.coalesce(F.get(ordered, j - 1)["k"] != e["k"], F.lit(True)))
        return F.transform(F.sort_array(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["v"].alias("v")))), lambda e: e["v"])

    # the first of equal words is the first of its spelling: sorting meets each word once
    trimmed = F.transform(F.array_distinct(F.coalesce(words, F.array().cast("array<string>"))), lambda x: F.btrim(F.coalesce(x, F.lit("")), F.lit(WHITE)))
    numbered = F.transform(F.filter(trimmed, lambda x: x != ""), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v")))
    return let(F.sort_array(numbered), body)


def leading_heading(text: Column) -> Column:
    """struct(section, title) of the numbered capital heading that a page begins with, or null."""
    head = F.regexp_replace(F.left(F.coalesce(text, F.lit("")), F.lit(300)), r"(?U)\A\s+", "")
    section = F.regexp_extract(head, HEADING, 1)
    rest = strip(F.regexp_extract(head, HEADING, 2))
    return F.when((section != "") & rest.rlike("[A-Z]"), F.struct(section.alias("section"), F.concat(section, F.lit(" "), rest).alias("title")))


def trigrams(c: Column) -> Column:
    """Distinct letter trigrams of the lower-case words, each padded by two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y)).cast("double")), F.lit(0.0))
