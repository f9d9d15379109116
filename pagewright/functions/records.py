"""Expressions over nested page records: formulas, tables, search and embedding texts, validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, first_filled, let, ordered_distinct, strip

VARIABLE = "struct<symbol:string,meaning:string>"
FORMULA = f"struct<name:string,latex:string,variables:array<{VARIABLE}>,context:string,describes:string>"
TABLE = "struct<caption:string,headers:array<string>,rows:array<array<string>>>"
DIAGRAM = "struct<caption:string,concepts:array<string>,description:string>"
GRAPH = "struct<title:string,x_axis:string,y_axis:string,meaning:string>"
CHEMICAL = "struct<equation:string,description:string>"
DERIVATION = "struct<title:string,goal:string,assumptions:array<string>,steps:array<string>,result:string>"
VISION_FIELDS = {
    "prose_text": "string",
    "section_identifiers": "array<string>",
    "formulas": f"array<{FORMULA}>",
    "derivations": f"array<{DERIVATION}>",
    "tables": f"array<{TABLE}>",
    "diagrams": f"array<{DIAGRAM}>",
    "graphs": f"array<{GRAPH}>",
    "chemical_equations": f"array<{CHEMICAL}>",
    "topics_detected": "array<string>",
    "key_terms": "array<string>",
}
VISION = "struct<" + ",".join(f"{k}:{v}" for k, v in VISION_FIELDS.items()) + ">"
RICH = f"struct<section_number:string,headline:string,definitions:array<string>,key_concepts:array<string>,formulas:array<{FORMULA}>,worked_examples:array<string>,exam_keywords:array<string>>"
PAGE_FIELDS = {
    "topics": "array<string>",
    "text": "string",
    "formulas": f"array<{FORMULA}>",
    "derivations": f"array<{DERIVATION}>",
    "tables": f"array<{TABLE}>",
    "diagrams": f"array<{DIAGRAM}>",
    "graphs": f"array<{GRAPH}>",
    "chemical_equations": f"array<{CHEMICAL}>",
    "summary": "string",
    "keywords": "array<string>",
    "search_text": "string",
    "section_identifiers": "array<string>",
}
PAGE = "struct<page_number:int," + ",".join(f"{k}:{v}" for k, v in PAGE_FIELDS.items()) + ">"
LOW_PROSE, MAX_DEFINITION = 50, 500


def some(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


def parse_vision(json: Column) -> Column:
    """Model output with every key there and of its type; what isn't is empty, one key at a time."""
    raw = F.from_json(json, VISION, {"mode": "PERMISSIVE"})
    empty = {k: F.lit("") if v == "string" else F.array().cast(v) for k, v in VISION_FIELDS.items()}
    return F.struct(*[F.coalesce(raw[k], empty[k]).alias(k) for k in VISION_FIELDS])


def _filled(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), " ")


def _variables(f: Column) -> Column:
    pair = lambda v: F.concat(F.coalesce(v["symbol"], F.lit("")), F.lit(": "), F.coalesce(v["meaning"], F.lit("")))
    known = F.filter(some(f["variables"], VARIABLE), lambda v: (F.coalesce(v["symbol"], F.lit("")) != "") | (F.coalesce(v["meaning"], F.lit("")) != ""))
    return F.transform(known, pair)


def formula_text(f: Column) -> Column:
    """Name, LaTeX, context (else description) and variables of one formula."""
    head = F.array(*[F.coalesce(x, F.lit("")) for x in (f["name"], f["latex"], first_filled(f["context"], f["describes"]))])
    return _filled(F.concat(head, _variables(f)))


def formulas_text(formulas: Column) -> Column:
    return F.array_join(F.transform(some(formulas, FORMULA), formula_text), " ")


def formula_embedding_text(formulas: Column) -> Column:
    """All parts of all formulas, context and description both."""
    parts = lambda f: F.concat(F.array(*[F.coalesce(f[k], F.lit("")) for k in ("name", "latex", "context", "describes")]), _variables(f))
    return _filled(F.flatten(F.transform(some(formulas, FORMULA), parts)))


def table_embedding_text(tables: Column) -> Column:
    parts = lambda t: F.concat(F.array(F.coalesce(t["caption"], F.lit(""))), F.flatten(some(t["rows"], "array<string>")))
    return _filled(F.flatten(F.transform(some(tables, TABLE), parts)))


def embedding_inputs(chunk_text: Column, content: Column, formulas: Column, tables: Column, older: bool = False) -> list[Column]:
    """The texts of the three embeddings of a chunk; formulas and tables fall back to the search text. older: the content
    doesn't stand in for a blank search text, and a formula gives its context or else its description, not both."""
    if older:
        search = F.coalesce(chunk_text, F.lit(""))
        return [search.alias("search_input"), first_filled(formulas_text(formulas), search).alias("formula_input"), first_filled(table_embedding_text(tables), search).alias("table_input")]
    search = first_filled(chunk_text, content)
    return [search.alias("search_input"), first_filled(formula_embedding_text(formulas), search).alias("formula_input"), first_filled(table_embedding_text(tables), search).alias("table_input")]


def choose_prose(vision: Column, tree: Column) -> Column:
    """The vision prose if there is some and it is half as long as the tree's text at least."""
    v, t = strip(F.coalesce(vision, F.lit(""))), F.coalesce(tree, F.lit(""))
    return F.when((v != "") & (F.length(v) >= 0.5 * F.length(strip(t))), v).otherwise(t)


def merged_page(vision: Column, tree_text: Column, headings: Column, node_summary: Column, normalize: bool = True) -> list[Column]:
    """Columns of a page record out of the vision record and what the tree says."""
    text = clean_text(choose_prose(vision["prose_text"], tree_text), normalize)
    topics = F.when(F.size(some(vision["topics_detected"], "string")) > 0, vision["topics_detected"]).otherwise(some(headings, "string"))
    cells = lambda t: F.array_join(F.flatten(some(t["rows"], "array<string>")), " ")
    both = lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.lit(" "), F.coalesce(b, F.lit("")))
    each = lambda k, kind, f: F.array_join(F.transform(some(vision[k], kind), f), " ")
    parts = F.array(
        text,
        formulas_text(vision["formulas"]),
        each("tables", TABLE, cells),
        each("diagrams", DIAGRAM, lambda d: F.coalesce(d["description"], F.lit(""))),
        each("graphs", GRAPH, lambda g: both(g["title"], g["meaning"])),
        each("chemical_equations", CHEMICAL, lambda c: both(c["equation"], c["description"])),
        F.coalesce(node_summary, F.lit("")),
        F.array_join(topics, " "),
        F.array_join(some(vision["key_terms"], "string"), " "),
        F.array_join(some(vision["section_identifiers"], "string"), " "),
    )
    same = [vision[k].alias(k) for k in ("formulas", "derivations", "tables", "diagrams", "graphs", "chemical_equations", "section_identifiers")]
    return [
        topics.alias("topics"),
        text.alias("text"),
        *same,
        first_filled(node_summary, F.left(text, F.lit(500))).alias("summary"),
        ordered_distinct(F.concat(some(vision["key_terms"], "string"), topics)).alias("keywords"),
        _filled(parts).alias("search_text"),
    ]


def formula_problem(f: Column) -> Column:
    """Why a formula isn't valid; an empty text if it is. The reasons are fixed values."""
    latex = F.coalesce(f["latex"], F.lit(""))
    count = lambda s: F.length(latex) - F.length(F.replace(latex, F.lit(s), F.lit("")))
    names = lambda word: F.sort_array(F.regexp_extract_all(latex, F.lit(r"\\" + word + r"\{([^}]+)\}"), F.lit(1)))
    variables = some(f["variables"], VARIABLE)
    flaw = lambda v: F.when(v.isNull(), "variable entry is not a dict").when(strip(F.coalesce(v["symbol"], F.lit(""))) == "", "variable missing symbol").when(strip(F.coalesce(v["meaning"], F.lit(""))) == "", "variable missing meaning")
    first_flaw = F.get(F.filter(F.transform(variables, flaw), lambda x: x.isNotNull()), F.lit(0))
    return (
        F.when(f.isNull(), "not a dict")
        .when(strip(latex) == "", "empty latex")
        .when(latex.rlike(r"(^|[^\\])\$"), "contains unescaped $ delimiters")
        .when(count("{") != count("}"), "unbalanced braces")
        .when(names("begin") != names("end"), "mismatched \\begin/\\end environments")
        .when(latex.rlike("[A-Za-z]") & (F.size(variables) == 0), "symbolic formula has no variable explanations")
        .otherwise(F.coalesce(first_flaw, F.lit("")))
    )


def valid_formulas(formulas: Column) -> Column:
    return F.filter(some(formulas, FORMULA), lambda f: formula_problem(f) == "")


def rejected_formulas(formulas: Column) -> Column:
    """A line for each formula that isn't valid."""
    bad = F.filter(some(formulas, FORMULA), lambda f: formula_problem(f) != "")
    return F.transform(bad, lambda f: F.concat(F.lit("dropped formula ("), formula_problem(f), F.lit("): "), F.left(F.coalesce(f["latex"], F.lit("")), F.lit(80))))


def page_flags(text: Column, diagrams: Column, tables: Column, graphs: Column, formulas: Column) -> list[Column]:
    low = F.length(strip(F.coalesce(text, F.lit("")))) < LOW_PROSE
    visual = (F.size(some(diagrams, DIAGRAM)) > 0) | (F.size(some(tables, TABLE)) > 0) | (F.size(some(graphs, GRAPH)) > 0)
    return [low.alias("low_prose"), (low & visual).alias("figure_only"), (F.size(some(formulas, FORMULA)) - F.size(valid_formulas(formulas))).alias("bad_formula_count")]


def latex_key(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def merge_formulas(vision: Column, summary: Column) -> Column:
    """One formula for each LaTeX key: of several in vision the last, at the place of the first; those in summary fill blanks
    in order, and bring new keys."""
    norm = lambda f: F.struct(*[F.coalesce(f[k], F.lit("")).alias(k) for k in ("name", "latex")], some(f["variables"], VARIABLE).alias("variables"), *[F.coalesce(f[k], F.lit("")).alias(k) for k in ("context", "describes")], latex_key(f["latex"]).alias("key"))
    clean = lambda a: F.filter(F.transform(F.filter(some(a, FORMULA), lambda f: f.isNotNull()), norm), lambda f: f["key"] != "")

    def both(v: Column, s: Column) -> Column:
        keys = F.array_distinct(F.concat(F.transform(v, lambda f: f["key"]), F.transform(s, lambda f: f["key"])))

        def one(k: Column) -> Column:
            mine = F.filter(v, lambda f: f["key"] == k)
            more = F.filter(s, lambda f: f["key"] == k)
            order = F.concat(F.slice(F.reverse(mine), 1, 1), more)  # the last of vision, then the summary's
            first = lambda k2: F.coalesce(F.get(F.filter(F.transform(order, lambda f: f[k2]), lambda x: x != ""), F.lit(0)), F.lit(""))
            listed = F.coalesce(F.get(F.filter(F.transform(order, lambda f: f["variables"]), lambda x: F.size(x) > 0), F.lit(0)), F.array().cast(f"array<{VARIABLE}>"))
            return F.struct(first("name").alias("name"), F.get(order, F.lit(0))["latex"].alias("latex"), listed.alias("variables"), first("context").alias("context"), first("describes").alias("describes"))

        return F.transform(keys, one)

    return F.get(F.transform(F.array(F.struct(clean(vision).alias("v"), clean(summary).alias("s"))), lambda x: both(x["v"], x["s"])), F.lit(0))


def serialise_summary(r: Column) -> Column:
    """A rich summary as labelled lines. The labels are fixed values."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.array(F.concat(F.lit(label + ": "), c))).otherwise(F.array().cast("array<string>"))
    each = lambda label, a: F.transform(some(a, "string"), lambda x: F.concat(F.lit(label + ": "), x))

    def formula(f: Column) -> Column:
        name, about = F.coalesce(f["name"], F.lit("")), first_filled(f["describes"], f["context"])
        head = F.concat(F.when(name != "", F.concat(F.lit("FORMULA ("), name, F.lit("): "))).otherwise("FORMULA: "), f["latex"], F.when(about != "", F.concat(F.lit(" — "), about)).otherwise(""))
        known = F.filter(some(f["variables"], VARIABLE), lambda v: (F.coalesce(v["symbol"], F.lit("")) != "") & (F.coalesce(v["meaning"], F.lit("")) != ""))
        return F.concat(F.array(head), F.transform(known, lambda v: F.concat(F.lit("  VAR: "), v["symbol"], F.lit(" = "), v["meaning"])))

    formulas = F.flatten(F.transform(F.filter(some(r["formulas"], FORMULA), lambda f: F.coalesce(f["latex"], F.lit("")) != ""), formula))
    words = some(r["exam_keywords"], "string")
    keywords = F.when(F.size(words) > 0, F.array(F.concat(F.lit("KEYWORDS: "), F.array_join(words, ", ")))).otherwise(F.array().cast("array<string>"))
    return F.array_join(
        F.concat(line("SECTION", r["section_number"]), line("OVERVIEW", r["headline"]), each("DEFINITION", r["definitions"]), each("CONCEPT", r["key_concepts"]), formulas, each("EXAMPLE", r["worked_examples"]), keywords), "\n"
    )


def split_gate(content: Column, page_start: Column, page_end: Column, key_concepts: Column, formulas: Column) -> Column:
    """Why a parent is split or not: a tag; too-short and below-threshold mean no split."""
    n = F.length(F.coalesce(content, F.lit("")))
    span = F.coalesce(page_end, F.lit(0)) - F.coalesce(page_start, F.lit(0))
    concepts = F.size(some(key_concepts, "string"))
    symbol = lambda f: F.get(F.filter(F.transform(some(f["variables"], VARIABLE), lambda v: strip(F.coalesce(v["symbol"], F.lit("")))), lambda s: s != ""), F.lit(0))
    symbols = F.size(F.array_distinct(F.filter(F.transform(some(formulas, FORMULA), lambda f: F.left(symbol(f), F.lit(1))), lambda s: s.isNotNull())))
    tag = lambda name, c, end=")": F.concat(F.lit(name + "("), c.cast("string"), F.lit(end))
    return (
        F.when(n < 800, "too-short")
        .when(span >= 2, tag("wide-span", span + 1, "p)"))
        .when(n >= 3000, tag("long-content", n))
        .when(concepts >= 4, tag("many-concepts", concepts))
        .when((symbols >= 2) & (F.size(some(formulas, FORMULA)) >= 2), tag("formula-hetero", symbols))
        .otherwise("below-threshold")
    )


def should_split(gate: Column) -> Column:
    return ~gate.isin("too-short", "below-threshold")


def span_problem(spans: Column, total: Column) -> Column:
    """What is wrong with spans (array of struct start_char, end_char) as a partition of total characters; empty if nothing. The texts are fixed values."""

    def body(s: Column) -> Column:
        n = F.size(s)
        first, last = F.get(s, F.lit(0))["start_char"], F.get(s, n - 1)["end_char"]
        text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))

        def flaw(x: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(0)).otherwise(F.get(s, i - 1)["end_char"])
            return (
                F.when(x["start_char"].isNull() | x["end_char"].isNull() | (x["start_char"] >= x["end_char"]), F.concat(F.lit("span["), i.cast("string"), F.lit("] invalid range "), text(x["start_char"]), F.lit(".."), text(x["end_char"])))
                .when(x["start_char"] != before, F.concat(F.lit("span["), i.cast("string"), F.lit("] start "), text(x["start_char"]), F.lit(" != previous end "), text(before)))
            )

        flaws = F.filter(F.transform(s, flaw), lambda x: x.isNotNull())
        return (
            F.when(n == 0, "no spans")
            .when(n < 2, "single span (no-op)")
            .when(n > 5, "too many spans")
            .when(~first.eqNullSafe(F.lit(0)), F.concat(F.lit("first span does not start at 0 (got "), text(first), F.lit(")")))
            .when(~last.eqNullSafe(total), F.concat(F.lit("last span ends at "), text(last), F.lit(", expected "), total.cast("string")))
            .otherwise(F.coalesce(F.get(flaws, F.lit(0)), F.lit("")))
        )

    return F.get(F.transform(F.array(spans), body), F.lit(0))


def fallback_spans(text: Column) -> Column:
    """Two or three parts cut at the blank lines nearest to equal lengths; empty if there is nothing to cut."""
    kind = "array<struct<start_char:int,end_char:int,title:string>>"
    mark = "\x01"  # control characters don't survive cleanup
    pieces = F.split(F.regexp_replace(text, r"(?U)\n\s*\n", "$0" + mark), mark)
    none = F.array().cast(kind)
    near = "struct<d:bigint,b:int>"

    def cut(x: Column) -> Column:  # one walk over the pieces, which keeps the break nearest to each part's end
        n, ends, parts = x["n"], x["ends"], F.size(x["ends"]) + 1
        best = lambda kept, t, k: F.least(kept, F.struct(F.abs(t - F.get(ends, F.lit(k))).alias("d"), t.alias("b")))  # noqa: E731  an end that isn't there has null, the larger
        start = F.struct(F.lit(0).alias("t"), F.lit(None).cast(near).alias("a"), F.lit(None).cast(near).alias("z"))
        step = lambda s, t: F.struct(t.alias("t"), best(s["a"], t, 0).alias("a"), F.when(parts == 3, best(s["z"], t, 1)).alias("z"))
        walked = F.aggregate(F.slice(x["pieces"], 1, F.size(x["pieces"]) - 1), start, lambda s, piece: let(s["t"] + F.length(piece), lambda t: step(s, t)))
        breaks = let(walked, lambda s: F.filter(F.array(s["a"]["b"], s["z"]["b"]), lambda b: b.isNotNull()))
        edges = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), breaks, F.array(n))))
        spans = lambda c: F.filter(F.transform(F.slice(c, 1, F.size(c) - 1), lambda s, i: F.struct(s.cast("int").alias("start_char"), F.get(c, i + 1).cast("int").alias("end_char"), F.concat(F.lit("Part "), (i + 1).cast("string")).alias("title"))), lambda p: p["end_char"] - p["start_char"] >= 200)
        stretch = lambda s: F.transform(s, lambda p, i: F.struct(F.when(i == 0, 0).otherwise(p["start_char"]).alias("start_char"), F.when(i == F.size(s) - 1, n).otherwise(p["end_char"]).cast("int").alias("end_char"), p["title"].alias("title")))
        made = let(edges, lambda c: F.when(F.size(c) < 3, none).otherwise(spans(c)))  # each step is computed once
        return let(made, lambda s: F.when(F.size(s) < 2, none).otherwise(stretch(s)))

    def body(n: Column) -> Column:  # lengths are counted once, not for each break
        end = lambda k, parts: F.floor(k * n / parts)
        ends = F.when(n >= 2400, F.array(end(1, 3), end(2, 3))).otherwise(F.array(end(1, 2)))
        return F.when(n < 800, none).otherwise(let(F.struct(n.alias("n"), ends.alias("ends"), pieces.alias("pieces")), lambda x: F.when(F.size(x["pieces"]) < 2, none).otherwise(cut(x))))

    return let(F.length(text), body)


def page_range(offsets: Column, start: Column, end: Column, first: Column, last: Column) -> Column:
    """Pages of the characters [start, end): offsets is array<struct<page,s,e>>; the last page that holds an end counts, the
    parent's pages stand in, and an inverted range is turned."""
    a = F.coalesce(F.try_element_at(F.filter(offsets, lambda o: (o["s"] <= start) & (start < o["e"])), F.lit(-1))["page"], first)
    b = F.coalesce(F.try_element_at(F.filter(offsets, lambda o: (o["s"] < end) & (end <= o["e"])), F.lit(-1))["page"], last)
    return F.struct(F.least(a, b).alias("page_start"), F.greatest(a, b).alias("page_end"))
