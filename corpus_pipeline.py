"""A corpus pipeline of the operators in pagewright.llm: each stage works on all that the one before it kept.

Every stage takes documents with nulls in any column, empty and very long texts, ties, repeated rows and extra columns, and empty
tables; all but the last return the columns that they were given. A document without id is never dropped for its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import decontamination, minhash, mixing, quality_rules, substring_dedup
from pagewright.llm._common import release, release_since, stage_table, table, written_so_far


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the base rules or a learned rule reject go; so do null and empty texts, which have no ten words. Repeated rows
    are judged alike. Without labels only the base rules decide."""
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, rules)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the document with the least id of each group of near-duplicates stays; rows that repeat a kept id are one. Texts without words
    and rows without id are linked with nothing and stay."""
    return minhash.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: passages of 50 words and more that occur more than once go from the texts, wherever they occur; the documents stay, with an empty
    text if nothing is left. A null text stays null. n_chars follows the text."""
    return substring_dedup.remove_repeats(docs, substring_dedup.PASSAGES)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a benchmark item, also a re-parameterised one, go. Null and empty texts have none; without items all stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: how many words of each document the mix takes; none of a null text. A null source is one of its own."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
]

#: SQL can't express the learned list, MinHash components and suffix arrays; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        mark = written_so_far()
        before, docs = docs, stage_table(stage(spark, docs, sf_dir), f"stage-{name}")
        release_since(mark, docs)
        release(before)
    return docs
