"""The English analyzer of the keyword lane: stop words and Porter's stemmer (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import terms

# Usual English stop words of full-text search.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves "
    "what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while "
    "of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()

ROWS = 2048  # of a batch that are stemmed at a time

# Suffix rules of steps 2, 3 and 4, as in the published algorithm.
STEP2 = dict(
    x.split(":")
    for x in (
        "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
    ).split()
)
STEP3 = dict(x.split(":") for x in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """Vowels and consonants of a word: v or c for each letter; y is a vowel after a consonant."""
    out = ""
    for k, ch in enumerate(word):
        vowel = ch in "aeiou" or ch == "y" and k > 0 and out[-1] == "c"
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short_end(stem: str) -> bool:
    """Consonant, vowel, consonant other than w, x, y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _replace(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + rules[suffix] if _measure(stem) > 0 else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isalpha():
        return word
    # plurals
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # past and progressive
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and "v" in _shape(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c" and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, STEP2), STEP3)
    for suffix in sorted(STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest = word[:-1]
        if _measure(rest) > 1 or _measure(rest) == 1 and not _short_end(rest):
            word = rest
    if word.endswith("ll") and _measure(word) > 1:
        word = word[:-1]
    return word


def _analyze(c: pa.Array) -> pa.Array:
    """A batch some rows at a time: what is held beside it doesn't grow with the batch."""
    c = pc.fill_null(c, pa.scalar([], c.type))
    return pa.concat_arrays([_stems(c.slice(k, ROWS)) for k in range(0, max(1, len(c)), ROWS)])


def _stems(c: pa.Array) -> pa.Array:
    """Each distinct word is stemmed once."""
    words = c.flatten().dictionary_encode()
    stop = set(ENGLISH_STOP_WORDS)
    stems = pa.array([None if w in stop else stem(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    kept = stems.is_valid()
    ends = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    at = np.concatenate([[0], np.cumsum(pc.list_value_length(c).to_numpy(zero_copy_only=False))])
    return pa.ListArray.from_arrays(pa.array(ends[at], pa.int32()), stems.drop_null())


def english_terms(c: Column) -> Column:
    """Stems of the words of a text that are no stop words."""
    return F.arrow_udf(_analyze, "array<string>")(terms(c))


def postings(rows: DataFrame, analyzer=terms, text: str = "search_text") -> DataFrame:
    """term, id, tf: the inverted index of rows (id, text)."""
    words = rows.select("id", F.explode(analyzer(F.col(text))).alias("term"))
    return words.groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))
