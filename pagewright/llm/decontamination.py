"""Operator 7: benchmark decontamination by template canonicalisation.

Words become lower-case letters and digits; numbers, the units after them and names (capitals within a sentence) become
typed placeholders. Windows of ``width`` canonical words of documents and items meet in a hash join. What stood in the
placeholders is carried along: a question that was given other numbers or names still matches, but each value of the item
must stand for the same value of the document throughout (slot consistency), so texts of equal shape and unrelated
content don't count.

Coverage and consistency are judged for each occurrence of an item by itself, so copies with other values don't speak against
each other. Matches of one occurrence have about the same alignment (place in the document less place in the item): equal ones,
ones in overlapping bands of an eighth and of half of the item's words (for words put in or left out), and, for items in pieces, all
matches of the document. An item whose matches of the document don't have the coverage has no occurrence that has it.

A window weighs as many as it has plain words, so those that are mostly placeholders say little. Windows with hardly any (below
``literals``, and two at least) would match anything of their shape, so they don't count as templates. An item with such windows is
also matched word by word (v 2): all its windows, with the values as they are, so that it is found verbatim, though, where no other windows
are left, not with other values.

Only windows that may be an item's are shuffled: a filter of bounded size over the items' windows is broadcast; the join is
exact. An item with fewer words than ``width`` is one window of all its words.

Defined results: a null or empty text has no windows and is clean; so is everything if there are no items; repeated rows
are judged alike; a null item text has no windows. Extra columns are kept by ``drop_contaminated``. Ties between items go to
the lower id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._chars import looked_up, points, tables
from ._common import key_filter, stage_table, table, with_matches
from ._vec import U, mix, powers, shingle_hashes, slices

#: Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degrees celsius fahrenheit "
    "meter meters metre metres kilometer kilometers centimeter centimeters watt watts kw volt volts hz mph kmh"
).split()
NUMBER, UNIT, NAME, VERBATIM = (U(x) for x in (0x1F3D5B79, 0x2E4C6A81, 0x3D5B7992, 0x4C6A81A3))


@dataclass(frozen=True)
class DeconParams:
    """A document is contaminated with an item if it has ``coverage`` of the weight of the item's windows and ``consistency`` of its slots
    agree. literals: the share of plain words that a template window has at least. broadcast_rows: the most rows of item windows
    that are broadcast; more of them are joined by shuffling."""

    width: int = 8
    literals: float = 0.375
    coverage: float = 0.5
    consistency: float = 0.75
    broadcast_rows: int = 500_000

    def least(self, width: int) -> int:
        return min(width, max(2, math.ceil(self.literals * width)))


@cache
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter or digit, digit, capital."""
    word, digit, capital = (np.zeros(0x10000, bool) for _ in range(3))
    for c in range(0x10000):
        ch = chr(c)
        digit[c] = ch.isdigit()
        word[c] = ch.isalpha() or digit[c]
        capital[c] = ch.isupper()
    return word, digit, capital


def _unit_hashes() -> np.ndarray:
    texts = list(UNITS)
    return np.sort(canonical(texts, units=False)[0])


@cache
def _units() -> np.ndarray:
    return _unit_hashes()


def canonical(texts: list[str], units: bool = True, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical words of all texts, the values behind placeholders (0 for a plain word), where each text's words begin."""
    return _typed(texts, units, names)[:3]


def _typed(texts: list[str], units: bool = True, names: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """canonical(), and all words as they are (in one case), where each text's begin."""
    word, digit, capital = _classes()
    cps, at = points(texts)
    space = (cps == 0x20) | ((cps >= 0x09) & (cps <= 0x0D)) | (cps == 0)
    is_word = looked_up(word, cps, True)
    k = np.flatnonzero(is_word)
    if not len(k):
        none = np.empty(0, np.uint64)
        return none, none, np.zeros(len(texts) + 1, np.int64), none, np.zeros(len(texts) + 1, np.int64)
    gaps = np.cumsum(space)  # the word that a letter belongs to
    own = gaps[k]
    head = np.flatnonzero(np.diff(own, prepend=-1) != 0)
    tail = np.append(head[1:], len(k))
    low = looked_up(tables()[1], cps[k], 0).astype(np.uint64)
    low = np.where(low == 0, cps[k], low).astype(np.uint64)
    up, down = powers(len(k) + 1)
    total = np.zeros(len(k) + 1, np.uint64)
    np.cumsum(mix(low) * up[: len(k)], out=total[1:])
    value = mix((total[tail] - total[head]) * down[head])
    start = k[head]
    number = np.diff(np.concatenate([[0], np.cumsum(looked_up(digit, cps[k], False))])[np.append(head, len(k))]) > 0
    # the first word of a sentence: after a line end, or after a word that ends with a full stop or the like
    stops = np.cumsum(np.isin(cps, [0, 0x0A, 0x21, 0x2E, 0x3A, 0x3F]))
    first = np.ones(len(head), bool)
    first[1:] = stops[start[1:]] != stops[k[tail[:-1] - 1]]
    second = looked_up(capital, cps[k[np.minimum(head + 1, len(k) - 1)]], False)  # words all in capitals are no names
    name = looked_up(capital, cps[start], False) & ~second & ~first & ~number & (tail - head > 1) & names
    if units:
        known = _units()
        hit = known[np.minimum(np.searchsorted(known, value), len(known) - 1)] == value
        unit = np.zeros(len(head), bool)
        unit[1:] = hit[1:] & number[:-1] & ~first[1:]
        name &= ~unit
    else:
        unit = np.zeros(len(head), bool)
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, value)))
    slot = np.where(number | unit | name, value, U(0))
    keep = np.ones(len(head), bool)
    keep[1:] = ~(name[1:] & name[:-1])  # a name of several words is one
    return token[keep], slot[keep], np.searchsorted(start[keep], at), mix(value ^ VERBATIM), np.searchsorted(start, at)


def _windows(typed: tuple[np.ndarray, ...], widths: list[int], p: DeconParams, own_width: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, its words, hashes, places, slots) of the windows with plain words enough; own_width: only of width min(width, words)."""
    token, slot, at = typed[:3]
    every = {w: shingle_hashes(token, w) for w in widths}
    plain = np.concatenate([[0], np.cumsum(slot == 0)])
    for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        n = b - a
        for w in [min(p.width, n)] if own_width else widths:
            if 0 < w <= n:
                place = np.arange(n - w + 1)
                ok = (plain[a + w : b + 1] - plain[a : b - w + 1]) >= p.least(w)
                place = place[ok]
                slots = np.lib.stride_tricks.sliding_window_view(slot[a:b], w)[place] if len(place) else np.empty((0, w), np.uint64)
                if w in every:
                    hashes = every[w][a + place]
                else:
                    hashes = shingle_hashes(token[a:b], w)[place]
                yield t, n, hashes, place, slots


def _verbatim(typed: tuple[np.ndarray, ...], p: DeconParams) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """As _windows: all windows of width min(width, words) of the words as they are; no slots."""
    value, at = typed[3:]
    for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if a < b:
            hashes = shingle_hashes(value[a:b], min(p.width, b - a))
            yield t, b - a, hashes, np.arange(len(hashes)), np.zeros((len(hashes), min(p.width, b - a)), np.uint64)


def _lists(slots: list[np.ndarray]) -> pa.Array:
    """Slots as lists; null where a window has no placeholder."""
    return pa.array([s.view(np.int64).tolist() if s.any() else None for s in slots], pa.list_(pa.int64()))


def _texts(column) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def _item_rows(batches: Iterator[pa.RecordBatch], p: DeconParams) -> Iterator[pa.RecordBatch]:
    """Windows of the items, once with names as placeholders (v 0) and once as plain words (v 1), as texts in one case have them; those of
    items with windows of few plain words also as they are (v 2)."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), _texts(batch.column(1))
        item, v, h, place, slots, width, n, words, weight = [], [], [], [], [], [], [], [], []
        both = [_typed(texts, names=names) for names in (True, False)]
        found = [[*_windows(typed, [p.width], p, True)] for typed in both]
        few = {t for t, length, hashes, _, own in found[0] if len(hashes) < length - own.shape[1] + 1}
        found.append([x for x in _verbatim(both[0], p) if x[0] in few])
        for kind, rows in enumerate(found):
            for t, length, hashes, places, own in rows:
                k = len(hashes)
                item += [ids[t]] * k
                v += [kind] * k
                h += hashes.view(np.int64).tolist()
                place += places.tolist()
                slots += list(own)
                width += [own.shape[1]] * k
                own_weight = (own == 0).sum(axis=1).tolist()
                weight += own_weight
                n += [sum(own_weight)] * k
                words += [length] * k
        columns = [pa.array(item, pa.int64()), pa.array(v, pa.int32()), pa.array(h, pa.int64()), *(pa.array(c, pa.int32()) for c in (place, width, n, words, weight)), _lists(slots)]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "v", "w", "ip", "width", "n", "words", "weight", "islots"])


def _doc_rows(batches: Iterator[pa.RecordBatch], widths: list[int], verbatim: list[int], held: Broadcast, p: DeconParams) -> Iterator[pa.RecordBatch]:

    def maybe(hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(held.value.has(hashes.view(np.int64)))

    for batch in batches:
        dk, th, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), _texts(batch.column(2))
        out: tuple[list, ...] = ([], [], [], [], [], [])
        for lo, hi in slices([len(t) for t in texts]):
            typed = _typed(texts[lo:hi])
            for t, _, hashes, places, own in _windows(typed, widths, p, False):
                hit = maybe(hashes)
                if len(hit):
                    out[0].extend([dk[lo + t]] * len(hit))
                    out[1].extend([th[lo + t]] * len(hit))
                    out[2].extend(hashes[hit].view(np.int64).tolist())
                    out[3].extend([own.shape[1]] * len(hit))
                    out[4].extend(places[hit].tolist())
                    out[5].extend(own[hit])
            value, at = typed[3:]
            for w in verbatim:
                hashes = shingle_hashes(value, w)
                hit = maybe(hashes)
                t = np.searchsorted(at, hit, "right") - 1
                inside = hit + w <= at[t + 1]
                hit, t = hit[inside], t[inside]
                out[0].extend(dk[lo + k] for k in t.tolist())
                out[1].extend(th[lo + k] for k in t.tolist())
                out[2].extend(hashes[hit].view(np.int64).tolist())
                out[3].extend([w] * len(hit))
                out[4].extend((hit - at[t]).tolist())
                out[5].extend(np.zeros((len(hit), w), np.uint64))
        if out[0]:
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:3]), *(pa.array(c, pa.int32()) for c in out[3:5]), _lists(out[5])], ["dk", "th", "w", "width", "dp", "dslots"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_dk": F.coalesce(F.col("doc_id"), F.lit(-1)).cast("long"), "_th": F.xxhash64(F.coalesce("text", F.lit("")))})


def _occurrences(shift: Column, words: Column) -> Column:
    """The occurrences that a match may belong to: (scale, band) of its alignment. Bands of two steps each overlap, so alignments
    within a step have one in common; at half of the item's words two whole copies have none in common."""
    out = [F.struct(F.lit(0).alias("scale"), F.lit(0).cast("long").alias("band")), F.struct(F.lit(1).alias("scale"), shift.cast("long").alias("band"))]
    for scale, part in ((2, 8), (3, 2)):
        band = F.floor(shift / F.greatest(F.lit(1), F.floor(words / part))).cast("long")
        out += [F.struct(F.lit(scale).alias("scale"), (band - k).alias("band")) for k in (0, 1)]
    return F.array(*out)


def matches(keyed: DataFrame, items: DataFrame, p: DeconParams = DeconParams()) -> DataFrame:
    """keyed: _dk, _th, text. dk, th, item_id, coverage, consistency of the contaminated ones."""
    spark = keyed.sparkSession
    own = stage_table(items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(partial(_item_rows, p=p), "item_id long, v int, w long, ip int, width int, n int, words int, weight int, islots array<long>"), "decon-items")
    kinds = own.select("width", (F.col("v") == 2).alias("verbatim")).distinct().collect()  # twice width of them at most
    widths, verbatim = (sorted(r["width"] for r in kinds if r["verbatim"] == kind) for kind in (False, True))
    if not kinds:
        return spark.createDataFrame([], "dk long, th long, item_id long, coverage double, consistency double")
    keys = own.select(F.col("w").alias("key")).distinct()
    if own.count() <= p.broadcast_rows:  # a window that many documents have is no task of its own then
        own = F.broadcast(own)
    held = spark.sparkContext.broadcast(key_filter(keys))
    found = keyed.select("_dk", "_th", "text").mapInArrow(partial(_doc_rows, widths=widths, verbatim=verbatim, held=held, p=p), "dk long, th long, w long, width int, dp int, dslots array<long>")
    # rows that repeat id and text bring each match as many times as the others: nothing below depends on it
    met = stage_table(found.join(own, ["w", "width"]), "decon-met")
    ids = ["dk", "th", "item_id", "v"]
    weights = F.collect_set(F.struct("ip", "weight"))
    total = lambda s: F.aggregate(s, F.lit(0), lambda a, x: a + x["weight"])
    met = met.withColumn("got", total(weights.over(Window.partitionBy(*ids)))).where(F.col("got") >= p.coverage * F.col("n"))
    met = met.withColumn("occurrence", F.explode(_occurrences(F.col("dp") - F.col("ip"), F.col("words"))))
    ids.append("occurrence")
    covered = met.groupBy(*ids).agg(total(weights).alias("got"), F.first("n").alias("n")).withColumn("coverage", F.col("got") / F.col("n")).where(F.col("coverage") >= p.coverage)
    pairs = met.where("islots is not null").select(*ids, F.explode(F.arrays_zip("islots", "dslots")).alias("s")).where("s.islots <> 0")
    each = pairs.groupBy(*ids, "s.islots", "s.dslots").agg(F.count("*").alias("c")).groupBy(*ids, "islots").agg(F.max("c").alias("best"), F.sum("c").alias("all"))
    agreed = each.groupBy(*ids).agg((F.sum("best") / F.sum("all")).alias("consistency"))
    both = covered.join(agreed, ids, "left").select(*ids, "coverage", F.coalesce("consistency", F.lit(1.0)).alias("consistency")).where(F.col("consistency") >= p.consistency)
    best = F.max_by(F.struct("coverage", "consistency"), F.struct("coverage", "consistency"))
    return both.groupBy("dk", "th", "item_id").agg(best.alias("b")).select("dk", "th", "item_id", "b.coverage", "b.consistency")


def decontaminate(docs: DataFrame, items: DataFrame, p: DeconParams = DeconParams()) -> DataFrame:
    """doc_id, contaminated, n_items, item_id (that with the most coverage), coverage, consistency of each row."""
    keyed = _keyed(docs.select("doc_id", "text"))
    best = matches(keyed, items, p).groupBy("dk", "th").agg(F.count("*").alias("n_items"), F.min(F.struct((-F.col("coverage")).alias("c"), "item_id", "coverage", "consistency")).alias("b"))
    out = keyed.select("doc_id", "_dk", "_th").join(best, (F.col("_dk") == F.col("dk")) & (F.col("_th") == F.col("th")), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.col("b.item_id").alias("item_id"), F.col("b.coverage").alias("coverage"), F.col("b.consistency").alias("consistency"))


def drop_contaminated(docs: DataFrame, items: DataFrame, p: DeconParams = DeconParams()) -> DataFrame:
    """The rows of docs that no item contaminates, with the columns of docs."""
    keyed = _keyed(docs)
    bad = stage_table(matches(keyed, items, p).select(F.col("dk").alias("_dk"), F.col("th").alias("_th")).distinct(), "decon-bad")
    return with_matches(keyed, bad, ["_dk", "_th"], "left_anti").select(*docs.columns)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
