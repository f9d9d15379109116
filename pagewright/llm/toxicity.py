"""Operator 3: toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters of other scripts, digits and signs that stand for letters) to words
divided by single marks. An Aho-Corasick automaton finds lexicon entries, which are whole words or beginnings of words,
and exception phrases; a hit within an exception phrase doesn't count, and a word counts once. The weights of the hits,
plain and for each hundred words, give the score through a logistic function.

Lexicon, weights, exceptions and the logistic function are learned from labelled rows: an entry must be so much more
frequent in toxic texts that chance explains it less than once in a hundred runs; of nested beginnings of a word the
strongest is taken. At most ``max_toxic`` and ``max_clean`` labelled documents are used (chosen by a
hash of the id). Exception phrases are learned from all hits of these texts: all phrases (a hit's word with the one before or after it) of
``clean_uses`` clean ones and no toxic one. ``max_clean`` bounds them.

Defined results: a null or empty text has no hits and gets the score of no hits; a null label isn't learned from;
without toxic labels every score is the share of toxic ones (0). Rows that repeat are scored alike. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, partial
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._chars import looked_up, points, tables
from ._common import crc_mod, only_ids, stage_table, table
from ._vec import slices

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
#: Digits and signs that stand for letters next to letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


@dataclass(frozen=True)
class ToxParams:
    """max_toxic and max_clean bound the labelled documents learned from; phrases of clean_uses clean and no toxic ones are exceptions (exceptions are
    further ones). Beginnings of shortest to longest letters are tried beside whole words. An entry must be least_odds times as frequent in
    toxic documents, and so strong that among candidates entries chance makes none in a hundred runs."""

    max_toxic: int = 2000
    max_clean: int = 10000
    shortest: int = 4
    longest: int = 14
    least_odds: float = 3.0
    candidates: int = 10_000_000
    exceptions: tuple[str, ...] = ()
    clean_uses: int = 5


@dataclass
class ToxModel:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    weights: tuple[float, float, float] = (-20.0, 0.0, 0.0)


@cache
def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    letter, lower, _ = tables()
    own = np.where(letter, lower, 0x20).astype(np.uint32)
    for c in range(0x10000):
        ch = chr(c).lower()
        if ch in HOMOGLYPHS:
            own[c] = ord(HOMOGLYPHS[ch])
        elif 0xFF21 <= c <= 0xFF5A and letter[c]:
            own[c] = ord(chr(c - 0xFEE0).lower())
    sub = np.zeros(0x10000, np.uint32)
    for a, b in SUBSTITUTES.items():
        sub[ord(a)] = ord(b)
    return own, sub


def fold(texts: list[str]) -> list[str]:
    """Each text as folded words, with a space before each of them and at the end."""
    own, sub = _fold_tables()
    cps, at = points(texts)
    out = looked_up(own, cps, 0x20)
    other = looked_up(sub, cps, 0)
    letter = out != 0x20
    stands = (other > 0) & np.concatenate([letter[1:], [False]])
    behind = (other > 0) & np.concatenate([[False], letter[:-1]]) & (cps < 0x3A) & (cps >= 0x30)
    out = np.where(stands | behind, other, out).astype(np.uint32)
    flat = out.tobytes().decode("utf-32-le", "surrogatepass")
    return [" " + flat[a : b - 1] + " " for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _folded(texts: list[str]) -> Iterator[str]:
    for lo, hi in slices([len(t) for t in texts]):
        yield from fold(texts[lo:hi])


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _entries(folded: str, params: ToxParams) -> set[str]:
    """The words (' abc ') and their beginnings (' abc') in a text."""
    words = set(folded.split())
    out = {f" {w} " for w in words}
    for w in words:
        for k in range(params.shortest, min(len(w), params.longest) + 1):
            out.add(" " + w[:k])
    return out


def _candidates(batches: Iterator[pa.RecordBatch], params: ToxParams, only: frozenset[str] | None) -> Iterator[pa.RecordBatch]:
    """text -> (entry, documents with it), summed over the batch; only: the entries to count."""
    for batch in batches:
        n: Counter = Counter()
        for text in _folded(_texts(batch.column(0))):
            found = _entries(text, params)
            n.update(found if only is None else found & only)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["entry", "n"])


def choose_entries(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """rows: entry, toxic and clean documents with it. Entries with their log-odds: the strongest first, and none that
    begins another one taken or is begun by it."""

    def strength(t: int, c: int) -> float:
        return t * math.log((t / toxic) / ((t + c) / (toxic + clean)))

    out: dict[str, float] = {}
    begun: set[str] = set()  # what begins an entry taken
    for _, _, e, t, c in sorted(((round(strength(t, c), 6), len(e), e, t, c) for e, t, c in rows), reverse=True):
        if e in begun or any(e[:k] in out for k in range(1, len(e))):
            continue
        out[e] = math.log(((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1)))
        begun.update(e[:k] for k in range(1, len(e) + 1))
    return out


class Matcher:
    def __init__(self, model: ToxModel):
        self.auto = ahocorasick.Automaton()
        for e, w in model.entries.items():
            self.auto.add_word(e, (len(e), w))
        for e in model.exceptions:
            self.auto.add_word(f" {e.strip()} ", (len(e.strip()) + 2, None))
        self.any = bool(model.entries)
        if self.any:
            self.auto.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, float]]:
        """Places (of the space before the word) and weights of the hits that count."""
        if not self.any:
            return []
        best: dict[int, float] = {}
        free: list[tuple[int, int]] = []
        for end, (n, w) in self.auto.iter(folded):
            start = end - n + 1
            if w is None:
                free.append((start, end))
            else:
                best[start] = max(w, best.get(start, w))
        free.sort()
        reach = list(accumulate((b for _, b in free), max))
        within = lambda p: bool(k := bisect_right(free, (p, len(folded) + 1))) and p < reach[k - 1]
        return [(p, w) for p, w in sorted(best.items()) if not within(p)]


def _features(weight: float, words: int) -> tuple[float, float]:
    return math.log1p(weight), math.log1p(100 * weight / max(words, 1))


_TWO_WORDS = re.compile(r"\s*(\S+)(?:\s+(\S+))?")


def _measure(batches: Iterator[pa.RecordBatch], model: ToxModel) -> Iterator[pa.RecordBatch]:
    """id, text -> id, hits, weight, words, phrases around the hits."""
    matcher = Matcher(model)
    for batch in batches:
        hits, weight, words, phrases = [], [], [], []
        for text in _folded(_texts(batch.column(1))):
            found = matcher.hits(text)
            hits.append(len(found))
            weight.append(sum(w for _, w in found))
            words.append(len(text.split()))
            around = set()
            for p, _ in found:
                own = [x for x in _TWO_WORDS.match(text, p).groups() if x]
                end = p
                while end and text[end - 1] == " ":
                    end -= 1
                before = [text[text.rfind(" ", 0, end) + 1 : end]] if end else []
                around |= {" ".join(own)} | {" ".join([*before, own[0]])}
            phrases.append([x for x in around if " " in x])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.int64()), pa.array(weight, pa.float64()), pa.array(words, pa.int64()), pa.array(phrases, pa.list_(pa.string()))], ["id", "hits", "weight", "words", "phrases"])


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the first column of x is 1."""
    b = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(x.shape[1]) * w.sum()
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * w.sum() * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, params: ToxParams = ToxParams()) -> ToxModel:
    """docs: doc_id, text; labels: doc_id, toxic; all of them may be learned from."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = own.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(n[0]), int(n[1]) - int(n[0])
    if not toxic or not clean:
        return ToxModel(exceptions=list(params.exceptions))
    scale = [min(1.0, m / k) for m, k in ((params.max_clean, clean), (params.max_toxic, toxic))]
    share = F.when(F.col("toxic") == 1, F.lit(int(scale[1] * (1 << 20)) + 1)).otherwise(F.lit(int(scale[0] * (1 << 20)) + 1))
    own = own.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < share)
    own = stage_table(own, "tox-labels")
    some = only_ids(docs.select("doc_id", "text"), own.select("doc_id")).join(own, "doc_id")
    some = stage_table(some.select(F.col("toxic").cast("int").alias("toxic"), "text"), "tox-train")
    n = some.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    toxic, clean = int(n[0]), int(n[1]) - int(n[0])
    if not toxic or not clean:
        return ToxModel(exceptions=list(params.exceptions))
    least = math.log(params.candidates) + math.log(100)
    support = math.ceil(least / math.log((toxic + clean) / toxic))  # with fewer toxic documents no entry is strong enough
    counted = lambda kind, only: some.where(F.col("toxic") == kind).select("text").mapInArrow(partial(_candidates, params=params, only=only), "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    often = {r["entry"]: r["n"] for r in counted(1, None).where(F.col("n") >= support).collect()}  # bounded by max_toxic
    also = {r["entry"]: r["n"] for r in counted(0, frozenset(often)).collect()}
    rows = []
    for e, t in often.items():
        c = also.get(e, 0)
        if t * math.log((t / toxic) / ((t + c) / (toxic + clean))) >= least and t / toxic >= params.least_odds * c / clean:
            rows.append((e, t, c))
    model = ToxModel(choose_entries(rows, toxic, clean), list(params.exceptions))
    measured = stage_table(some.mapInArrow(partial(_measure, model=model), "toxic int, hits long, weight double, words long, phrases array<string>"), "tox-measured")
    phrases = measured.select("toxic", F.explode(F.array_distinct("phrases")).alias("p")).groupBy("p").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    free = [r["p"] for r in phrases.where((F.col("t") == 0) & (F.col("n") >= params.clean_uses)).orderBy(F.desc("n"), "p").collect()]
    if free:
        model.exceptions += free
        measured = some.mapInArrow(partial(_measure, model=model), "toxic int, hits long, weight double, words long, phrases array<string>")
    rows = measured.select("toxic", "weight", "words").toPandas()
    x = np.array([(1.0, *_features(w, k)) for w, k in zip(rows["weight"], rows["words"], strict=True)])
    y = rows["toxic"].to_numpy(float)
    weight = np.where(y == 1, 1 / scale[1], 1 / scale[0])
    model.weights = tuple(_logistic(x, y, weight, 1e-5))
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: ToxModel) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(model)
    b = model.weights
    for batch in batches:
        hits, score = [], []
        for text in _folded(_texts(batch.column(1))):
            found = matcher.hits(text)
            f = _features(sum(w for _, w in found), len(text.split()))
            hits.append(len(found))
            score.append(1 / (1 + math.exp(-max(-30.0, min(30.0, b[0] + b[1] * f[0] + b[2] * f[1])))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(hits, pa.int64())], ["doc_id", "score", "hits"])


def score_toxicity(docs: DataFrame, model: ToxModel) -> DataFrame:
    """doc_id, score and the number of hits of each row."""
    return docs.select("doc_id", "text").mapInArrow(partial(_scores, model=model), "doc_id long, score double, hits long")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    model = train(docs.select("doc_id", "text"), labels.where(~held_out).select("doc_id", "toxic"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits")
