"""Operator 1: quality rules as a learned decision list, in DataFrame functions only.

Sequential covering over labelled statistics: one rule at a time is grown (the threshold condition with the
largest FOIL gain is added until no gain is left), pruned on rows that growing has not seen, and kept if it is
still precise there; rows that it covers leave, and the next rule is grown. The list is an ordered
``CASE WHEN`` of threshold conjunctions. All statistics are Spark aggregates; the driver sees at most
(features x cuts) counts for each condition.

Defined results: a null or empty text has no words, fails the base rules and is not kept. Repeated rows and
repeated ids are judged row by row. Labels that are null are not used; an id labelled twice takes the lower label.
Extra columns of the input are ignored. An empty table gives an empty result; without labels of both kinds the
list has no rule and only the base rules decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WHITE, let, stage_table, table

SYMBOLS = r"[#*$%&|<>]+"


@dataclass(frozen=True)
class RuleParams:
    """max_labelled bounds the labelled rows that the list is fitted on (chosen by a hash of the id). cuts: thresholds tried for a feature; max_rules and
    max_conditions: size of the list; min_cover: rows to reject that a rule covers at least; min_precision: on the rows that prune."""

    max_labelled: int = 20_000
    cuts: int = 48
    max_rules: int = 8
    max_conditions: int = 3
    min_cover: int = 8
    min_precision: float = 0.9


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass
class DecisionList:
    """Ordered rules; a row that meets a rule is rejected, any other row is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rule_number(self) -> Column:
        """1-based number of the first rule that a row meets, null if none."""
        if not self.rules:
            return F.lit(None).cast("int")
        out = None
        for n, rule in enumerate(self.rules, 1):
            test = reduce(lambda a, b: a & b, [c.column() for c in rule])
            out = F.when(test, F.lit(n)) if out is None else out.when(test, F.lit(n))
        return out

    def __str__(self) -> str:
        return "\n".join(f"{n}. reject if " + " and ".join(map(str, r)) for n, r in enumerate(self.rules, 1))


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in 5-word windows that the text has twice or more. Equal hashes only select the texts to look at:
    the count itself compares the words."""

    def covered(windows: Column) -> Column:
        def adjacent(ordered: Column) -> Column:
            hit = F.filter(
                ordered,
                lambda e, j: (F.get(ordered, j - 1)["w"] == e["w"]) | F.coalesce(F.get(ordered, j + 1)["w"] == e["w"], F.lit(False)),
            )
            return F.sort_array(F.transform(hit, lambda e: e["i"]))

        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        return F.aggregate(
            let(pairs, lambda o: F.coalesce(adjacent(o), F.array().cast("array<int>"))),
            start,
            lambda a, i: F.struct((i + 5).alias("end"), (a["sum"] + 5 - F.greatest(F.lit(0), a["end"] - i)).alias("sum")),
            lambda a: a["sum"],
        )

    at = F.sequence(F.lit(0), n - 5)
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(5)]))
    exact = F.transform(at, lambda i: F.array_join(F.slice(words, i + 1, 5), " "))
    some = let(hashes, lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(n < 5, F.lit(0)).when(some, covered(exact)).otherwise(F.lit(0))


def with_features(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs and, in columns that start with _q_, the base counts and the ratios that the rules test."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.regexp_replace(x, WHITE, "") != "")
    a = docs.withColumns({"_q_words": F.array_remove(F.split(t, WHITE), ""), "_q_lines": lines})
    n = F.size("_q_words")
    length = F.length(t)
    b = a.withColumns(
        {
            "_q_n_words": n,
            "_q_word_chars": F.length(F.array_join("_q_words", "")),
            "_q_n_symbols": length - F.length(F.regexp_replace(t, SYMBOLS, "")),
            "_q_n_dup_lines": F.size("_q_lines") - F.size(F.array_distinct("_q_lines")),
            "_q_n_repeat_words": _repeat_words(F.col("_q_words"), n),
            "_q_n_lines": F.size("_q_lines"),
            "_q_n_distinct": F.size(F.array_distinct("_q_words")),
            "_q_n_upper": length - F.length(F.regexp_replace(t, r"\p{Lu}+", "")),
            "_q_n_marks": length - F.length(F.regexp_replace(t, r"[!?]+", "")),
        }
    ).drop("_q_words", "_q_lines")
    per = lambda x, y: F.when(F.col(y) > 0, F.col(x) / F.col(y)).otherwise(F.lit(0.0))
    return b.withColumns(
        {
            "_q_symbol_ratio": per("_q_n_symbols", "_q_word_chars"),
            "_q_upper_ratio": per("_q_n_upper", "_q_word_chars"),
            "_q_mark_ratio": per("_q_n_marks", "_q_n_words"),
            "_q_dup_line_ratio": per("_q_n_dup_lines", "_q_n_lines"),
            "_q_repeat_ratio": per("_q_n_repeat_words", "_q_n_words"),
            "_q_variety": per("_q_n_distinct", "_q_n_words"),
            "_q_word_length": per("_q_word_chars", "_q_n_words"),
            "_q_size": F.col("_q_n_words").cast("double"),
        }
    )


FEATURES = ["_q_symbol_ratio", "_q_upper_ratio", "_q_mark_ratio", "_q_dup_line_ratio", "_q_repeat_ratio", "_q_variety", "_q_word_length", "_q_size"]


def base_failed() -> Column:
    n, r = F.col("_q_n_words"), F.col("_q_n_repeat_words")
    return (n < 10) | (100 * r.cast("long") > 20 * n.cast("long"))


def fit(labelled: DataFrame, params: RuleParams = RuleParams()) -> DecisionList:
    """labelled: FEATURES, bad (1 for the rows to reject) and _grow (false for the rows that prune)."""
    quantiles = [i / params.cuts for i in range(1, params.cuts)]
    cuts_row = labelled.agg(*[F.percentile_approx(f, quantiles, 2000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(cuts_row[f] or [])) for f in FEATURES}
    out = DecisionList()
    uncovered = F.lit(True)
    below = lambda f: sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0))
    measures = F.array(*[F.struct(F.lit(f).alias("f"), below(f).alias("bin")) for f in FEATURES])
    binned = stage_table(labelled.withColumn("_bins", measures), "rules-bins")

    def counts(rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.count("*")).first()
        return int(r[0]), int(r[1]) - int(r[0])

    for _ in range(params.max_rules):
        rest = binned.where(uncovered)
        grow, prune = rest.where("_grow"), rest.where("not _grow")
        rule: list[Condition] = []
        p, n = counts(grow)
        while p >= params.min_cover and n and len(rule) < params.max_conditions:
            here = grow.where(reduce(lambda a, b: a & b, [c.column() for c in rule], F.lit(True)))
            stats = here.select("bad", F.explode("_bins").alias("b")).groupBy("b.f", "b.bin").agg(F.sum("bad").alias("p"), F.count("*").alias("t")).collect()
            best = _best(stats, cuts, p, n, params.min_cover)
            if best is None:
                break
            gain, condition, p, n = best
            rule.append(condition)
        if not rule:
            break
        rule, precise, covered = _pruned(prune, rule)
        if precise < params.min_precision or covered < max(1, params.min_cover // 4):
            break
        out.rules.append(rule)
        uncovered = uncovered & ~reduce(lambda a, b: a & b, [c.column() for c in rule])
    return out


def _best(stats, cuts, p0: int, n0: int, least: int):
    base = math.log2(p0 / (p0 + n0))
    best = None
    for f, own in cuts.items():
        bins = sorted((int(r["bin"]), int(r["p"]), int(r["t"]) - int(r["p"])) for r in stats if r["f"] == f)
        for k, cut in enumerate(own):  # bin b holds the rows above the first b cuts
            up = [sum(x[i] for x in bins if x[0] > k) for i in (1, 2)]
            for above, (p, n) in ((True, up), (False, [p0 - up[0], n0 - up[1]])):
                if p >= least and (p, n) != (p0, n0):
                    gain = p * (math.log2(p / (p + n)) - base)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, Condition(f, above, float(cut)), p, n)
    return best


def _pruned(rows: DataFrame, rule: list[Condition]) -> tuple[list[Condition], float, int]:
    """The prefix of the rule with the best precision on rows (the shorter one on ties)."""
    tests, whole = [], F.lit(True)
    for c in rule:
        whole = whole & c.column()
        tests.append(whole)
    aggs = []
    for k, t in enumerate(tests):
        aggs += [F.count_if(t & (F.col("bad") == 1)).alias(f"p{k}"), F.count_if(t).alias(f"t{k}")]
    r = rows.agg(*aggs).first()
    value = [(r[f"p{k}"] / r[f"t{k}"] if r[f"t{k}"] else 0.0) for k in range(len(rule))]
    k = max(range(len(rule)), key=lambda k: (round(value[k], 3), -k))
    return rule[: k + 1], value[k], int(r[f"t{k}"])


def chosen(labels: DataFrame, params: RuleParams = RuleParams()) -> tuple[DataFrame, Column]:
    """The labels to fit on (doc_id, _quality), about max_labelled of them at most, and the test of doc_id that chose them."""
    own = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    total = own.count()
    test = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, params.max_labelled / max(1, total)))
    return own.where(test), test


def labelled_rows(features: DataFrame, own: DataFrame) -> DataFrame:
    """Features of the labelled rows that pass the base rules. own: of chosen(), so small that it may be broadcast."""
    own = F.broadcast(own)
    return (
        features.withColumn("_q_row", F.monotonically_increasing_id())
        .where((F.col("_q_row") >= 0) & ~base_failed())
        .join(own.withColumnRenamed("doc_id", "_label_id"), F.col("doc_id") == F.col("_label_id"))
        .select(*FEATURES, (F.col("_quality") == 0).cast("int").alias("bad"), (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(3)) > 0).alias("_grow"))
    )


def learn(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DecisionList:
    """Fit on the labelled ones of docs. Features are computed where the choice of labels may fall, before the join: no text is shuffled, and of a large
    corpus a small part is looked at."""
    own, test = chosen(labels, params)
    features = with_features(docs.select("doc_id", "text").where(test)).drop("text")
    return fit(stage_table(labelled_rows(features, own), "rules-labelled"), params)


def keep_good(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The rows of docs that neither the base rules nor a learned rule reject, with the columns of docs."""
    # the row number keeps the optimizer from moving the test below the columns that it reads, where each use would
    # compute them again
    features = with_features(docs).withColumn("_q_row", F.monotonically_increasing_id())
    return features.where((F.col("_q_row") >= 0) & ~base_failed() & rules.rule_number().isNull()).select(*docs.columns)


def quality_rules(docs: DataFrame, labels: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """One row for each document: the base counts, base_failed, kept and the number of the rule that rejected it."""
    features = stage_table(with_features(docs.select("doc_id", "text")).drop("text"), "rules-features")
    own, test = chosen(labels, params)
    rules = fit(stage_table(labelled_rows(features.where(test), own), "rules-labelled"), params)
    number = F.when(~base_failed(), rules.rule_number())
    longs = [F.col(f"_q_{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return features.select("doc_id", *longs, base_failed().alias("base_failed"), (~base_failed() & number.isNull()).alias("kept"), number.alias("rule"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
