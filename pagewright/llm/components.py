"""Connected components by alternating large-star and small-star (Kiveris et al. 2014) as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import release, stage_table


def _lowest(edges: DataFrame) -> DataFrame:
    """u and the least of u and its neighbours; written, so that what is joined to it is shuffled as it is and the rows of a hub can be split."""
    return stage_table(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node that has an edge to another node; label is the least node of its component."""
    und = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stage_table(und, "cc")
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage_table(large, "cc")
        release(low)
        low = _lowest(large)
        down = large.join(low, "u")
        small = down.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = stage_table(small, "cc")
        release(large)
        release(low)
        new = _state(after)
        release(now)
        now = after
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        state = new
    raise RuntimeError("components did not converge")
