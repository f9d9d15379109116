"""Operator 8: mixing sources to target weights with a low-discrepancy schedule, in DataFrame functions only.

Slot k of the mix has the golden-ratio point frac(k * phi); the point falls into the source whose share of the
cumulative targets holds it, and the slots of a source are ranked. The documents of a source, shuffled by a hash of
their ids, lie one after another on a line of words that is read round and round; the words of the target, from the start of
the line, are divided evenly between the source's slots, so each source has a block length of its own and takes its target to
the word. A source that no point falls into has one slot, after the others. So the mix is even at every length, whatever
prefix of it is read, and a source much smaller than a slot isn't lost.

No task sees a whole source: documents are dealt by (source, shard), where shard is a part of the hash.

Defined results: a null text has size 0 and is taken 0 times; a null source is a source of its own, last in
order; repeated rows are mixed one by one; sources of size 0 have target 0; an empty table gives an empty result.
Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WHITE, stage_table, table

GOLDEN = 0.6180339887498949


@dataclass(frozen=True)
class MixParams:
    """weights repeat over the ordered sources; slots is the length of the schedule at most (blocks are
    of one word at least); a document is taken max_repeat times at most. A source's documents are dealt to as many shards as leave
    about shard_rows of all rows in one, shards at least; the schedule looks its points up in bins."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    slots: int = 1 << 19
    shards: int = 256
    shard_rows: int = 1_000_000
    bins: int = 4096
    max_repeat: int = 3


def size_of(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE), "")).cast("long")


def targets(sources: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """sources (source, source_size), one row each, and rank, weight and target: min(cap, level * weight), where the
    level makes the targets sum to all sizes. That is where resharing the excess ends."""
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    w = sources.withColumn("rank", F.row_number().over(everything) - 1)
    weights = F.array(*[F.lit(float(x)) for x in params.weights])
    w = w.withColumn("weight", F.get(weights, (F.col("rank") % len(params.weights)).cast("int"))).withColumn("cap", (F.col("source_size") * params.max_repeat).cast("double"))
    by = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank"))
    all_rows = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("full")) / F.col("left"))
        # the first source, in this order, whose cap isn't below the level has the level that holds
        .withColumn("holds", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.row_number().over(by).alias("n"), F.col("level").alias("level")))).over(all_rows)["level"])
    )
    return w.select("source", "source_size", "rank", "weight", F.when(F.col("holds").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("holds") * F.col("weight"))).alias("target"))


def schedule(plan: DataFrame, spark: SparkSession, params: MixParams = MixParams()) -> DataFrame:
    """plan: targets(), block_size and quota. One row for each slot: slot, source rank, number among its source's slots (nth) and how many
    they are (own_slots). The slot takes words nth * quota / own_slots to (nth + 1) * quota / own_slots of its source, rounded down."""
    total = F.sum("target").over(Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    upto = F.sum("target").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    spans = (
        plan.withColumn("hi", upto / total)
        .withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("rank")), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("rank").over(Window.orderBy("rank")).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
        .where("quota > 0")
        .withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") * params.bins), F.least(F.floor(F.col("hi") * params.bins), F.lit(params.bins - 1).cast("long")))))
        .select("bin", "rank", "lo", "hi")
    )
    whole = plan.agg(F.sum("source_size"), F.max("block_size")).first()
    n_slots = -(-int(whole[0] or 0) // int(whole[1] or 1))
    point = F.col("id") * F.lit(GOLDEN)
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("x")).withColumn("bin", F.floor(F.col("x") * params.bins))
    placed = slots.join(spans, "bin").where("x >= lo and x < hi").select("slot", "rank")
    # ranks within a source: sources that own most slots are ranked in ranges of slots, with the counts before each
    width = max(1, n_slots // params.shards)
    placed = stage_table(placed.withColumn("part", F.floor(F.col("slot") / width)), "mix-slots")
    parts = stage_table(placed.groupBy("rank", "part").agg(F.count("*").alias("n")), "mix-parts")
    before = (
        parts
        .withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select("rank", "part", "before")
    )
    ranked = placed.withColumn("own", F.row_number().over(Window.partitionBy("rank", "part").orderBy("slot"))).join(before, ["rank", "part"])
    ranked = ranked.select("slot", "rank", (F.col("before") + F.col("own") - 1).alias("nth")).join(parts.groupBy("rank").agg(F.sum("n").alias("own_slots")), "rank")
    missed = plan.where("quota > 0").join(parts, "rank", "left_anti")
    missed = missed.select((F.lit(n_slots) + F.row_number().over(Window.orderBy("rank")) - 1).cast("long").alias("slot"), "rank", F.lit(0).cast("long").alias("nth"), F.lit(1).cast("long").alias("own_slots"))
    return ranked.select("slot", "rank", F.col("nth").cast("long").alias("nth"), "own_slots").unionByName(missed)


def mix(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the schedule takes."""
    spark = docs.sparkSession
    h = F.xxhash64("doc_id")
    sized = stage_table(
        docs.select("doc_id", "source", size_of(F.col("text")).alias("size")).select(
            "doc_id", "source", "size", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")).alias("key"), h.alias("h")
        ),
        "mix-sizes",
    )
    shards = max(params.shards, -(-sized.count() // params.shard_rows))
    sized = sized.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    shards = sized.groupBy("key", "source", "shard").agg(F.sum("size").alias("shard_size"))
    sources = shards.groupBy("key", "source").agg(F.sum("shard_size").alias("source_size"))
    block = F.greatest(F.lit(1), F.ceil(F.sum("source_size").over(Window.partitionBy()) / params.slots)).cast("long")
    plan = sources.select("key", "source", "source_size", block.alias("block_size"))
    plan = targets(plan.select("source", "source_size"), params).join(plan.select("key", F.col("source").alias("s"), "block_size"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = stage_table(plan.withColumn("quota", F.round("target").cast("long")), "mix-plan")
    slots = stage_table(schedule(plan, spark, params), "mix-schedule")
    counts = slots.groupBy("rank").agg(F.first("own_slots").alias("own_slots"))
    plan = stage_table(plan.join(counts, "rank", "left"), "mix-counts")
    offset = F.coalesce(F.sum("shard_size").over(Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = shards.withColumn("offset", offset).select("key", "shard", "offset").join(plan.select("key", "rank", "source_size", "target", "quota", "own_slots"), "key")
    before = Window.partitionBy("key", "shard").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = sized.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).join(where, ["key", "shard"]).withColumn("start", F.col("start") + F.col("offset"))
    line = stage_table(line.select("doc_id", "source", "size", "source_size", "target", "rank", "start", "quota", "own_slots"), "mix-line")
    # the line is read max_repeat times at most; the piece of a document in a slot is where their words overlap
    again = line.where("size > 0 and quota > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(params.max_repeat - 1))))
    again = again.withColumn("s", F.col("start") + F.col("turn") * F.col("source_size")).withColumn("e", F.least(F.col("s") + F.col("size"), "quota")).where("s < e")
    slot_of = lambda word: F.expr(f"(({word} + 1) * own_slots - 1) div quota")
    pieces = again.withColumn("nth", F.explode(F.sequence(slot_of("s"), slot_of("e - 1"))))
    pieces = pieces.withColumn("words", F.least("e", F.expr("((nth + 1) * quota) div own_slots")) - F.greatest("s", F.expr("(nth * quota) div own_slots")))
    taken = pieces.join(slots.select("rank", "nth"), ["rank", "nth"]).groupBy("rank", "start").agg(F.sum("words").alias("taken"))
    keyed = line.withColumn("at", F.when(F.col("size") > 0, F.col("start")))  # documents of no words take no place on the line
    taken = taken.withColumnRenamed("start", "at")
    return keyed.join(taken, ["rank", "at"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "taken")
