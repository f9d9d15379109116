"""Operator 12: packing documents into training sequences by power-of-two decomposition.

A document's tokens (its ids and an end id) are cut into pieces whose lengths are powers of two, at most ``longest``: whole pieces of that
length first, then the binary digits of the rest, largest first. Each piece is a sequence of its own, so no sequence crosses documents and none
has padding; a training step takes sequences of one length (Pouransari et al. 2024, dataset decomposition). ``pack`` returns a row for each
piece, sequences of equal length numbered one after another in an order that a hash shuffles, with the ids of the piece if asked for.

The ids are those of the tokenizer. Texts of plain Latin letters are tokenized by their words, which the tokenizer never joins: words that a
worker has met are looked up, the others are given to the tokenizer's model. All other texts go to the tokenizer as they are. tests/llm compares.

Defined results: a null or empty text has the end id alone; repeated rows are packed one by one; a null doc_id stays null; an empty
table gives an empty result. Extra columns are ignored. Texts of any length are whole. What a task holds beside a batch are the ids of one document.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import stage_table, table

KINDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@dataclass(frozen=True)
class PackParams:
    """tokenizer is the path of a tokenizers file, end_id follows each document, longest (a power of two) is the longest sequence. A worker remembers
    about twice max_words words, those of max_word_chars characters at most. Pieces are numbered in shards of about shard_rows rows, shards at least."""

    tokenizer: str = ""
    end_id: int = 2
    longest: int = 4096
    max_words: int = 1 << 19
    max_word_chars: int = 64
    shards: int = 64
    shard_rows: int = 1_000_000


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c)).startswith(kind))


#: Texts whose words can be looked up: no combining marks, nothing that changes when it is normalised twice, white space that all agree on.
_PLAIN = re.compile("[\t\n\r -~¡-įı-ſ]*")
#: The words that the tokenizer's own pattern finds in a plain text.
_UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[%(L)s]+|[%(N)s]|[^ %(L)s%(N)s]+" % {"L": _class("L"), "N": _class("N")})
#: Punctuation at the end of a word of letters is a unit of its own: set apart, the word is met more often.
_MARKS = ".,;:!?"
_PROSE = re.compile(f"[{_class('Ll')} \n{_MARKS}]*")
_AFTER = re.compile(r"(?<=[%s])([.,;:!?]+)(?=[ \n]|\Z)" % _class("Ll"))


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for the letters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds:
    """The ids of texts by a tokenizer of lower-case words with word ends, with a memory of words in two generations."""

    def __init__(self, path: str, max_words: int, max_word_chars: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _alphabet()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.max_words, self.max_word_chars = max_words, max_word_chars

    def _new(self, unit: str) -> bytes:
        tokens = self.model.tokenize(unit if unit.isascii() else unit.encode().decode("latin-1").translate(self.letters))
        found = array("I", [t.id for t in tokens]).tobytes()
        if len(unit) <= self.max_word_chars:
            self.known[unit] = found
        return found

    def _word(self, word: str) -> bytes:
        """Of a word that isn't known."""
        if word.isalpha():
            return self._new(word)
        return b"".join([self.known.get(u) or self.older.get(u) or self._new(u) for u in _UNITS.findall(word)])

    def of(self, text: str) -> np.ndarray:
        """All ids of text (unsigned 32 bits)."""
        if not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        words = _apart(text.lower()).split()
        own: dict[str, bytes] = {}
        for w in set(words).difference(self.known):
            found = self.older.get(w) or self._word(w)
            if len(w) <= self.max_word_chars:
                self.known[w] = found
            else:
                own[w] = found
        find = (lambda w: own.get(w) or self.known[w]) if own else self.known.__getitem__
        ids = np.frombuffer(b"".join(map(find, words)), np.uint32)
        if len(self.known) > self.max_words:
            self.known, self.older = {}, self.known
        return ids


@lru_cache(maxsize=1)
def _word_ids(path: str, max_words: int, max_word_chars: int) -> WordIds:
    return WordIds(path, max_words, max_word_chars)


def _apart(text: str) -> str:
    """text (lower case) with the marks that end words set apart. Where nothing but letters and white space is beside marks, and each mark ends a word, plain replacement does."""
    marks = [c for c in _MARKS if c in text]
    if not _PROSE.fullmatch(text) or any(text.count(c) != text.count(c + " ") + text.count(c + "\n") + text.endswith(c) or " " + c in text or "\n" + c in text for c in marks) or text[:1] in _MARKS:
        return _AFTER.sub(r" \1", text)
    for c in marks:
        text = text.replace(c, " " + c)
    return text


def lengths(tokens: int, longest: int) -> list[int]:
    """Powers of two that sum to tokens, none above longest, largest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _tokenizer(p: PackParams) -> str:
    if p.tokenizer:
        return p.tokenizer
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(docs: DataFrame, p: PackParams = PackParams(), with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(_tokenizer(p), p.max_words, p.max_word_chars)
        for batch in batches:
            rows: list[tuple] = []
            pieces: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(words.of(text.as_py() or ""), np.uint32(p.end_id)).astype("<u4")
                start = 0
                for n in lengths(len(ids), p.longest):
                    own = ids[start : start + n]
                    rows.append((doc_id, start, n, zlib.crc32(own), len(ids)))
                    if with_ids:
                        pieces.append(own.astype(np.int32))
                    start += n
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, KINDS + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, p: PackParams = PackParams(), with_ids: bool = True) -> DataFrame:
    """cut() and where each piece lies: sequence_id and offset. Sequences of a length are numbered without gaps after all shorter ones, in the order of a
    hash, so reruns agree. Pieces are counted by shards of that hash, so no task numbers all sequences of a length."""
    pieces = stage_table(cut(docs, p, with_ids), "pack-pieces")
    shards = max(p.shards, -(-pieces.count() // p.shard_rows))
    h = F.xxhash64("doc_id", "start", "ids_crc32")
    dealt = pieces.withColumns({"h": h, "shard": F.pmod(h, F.lit(shards)).cast("int")})
    counts = dealt.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each length and shard
    offsets = counts.select("length", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("length", "shard").orderBy("h", "doc_id", "start", "ids_crc32", "doc_tokens"))
    placed = dealt.withColumn("number", number).join(offsets, ["length", "shard"])
    return placed.select(*pieces.columns, (F.col("before") + F.col("number") - 1).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
