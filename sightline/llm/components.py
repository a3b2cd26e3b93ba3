"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(pairs: DataFrame) -> DataFrame:
    """(u, least): the least of u and its partners. The partial minimum keeps a hub from being gathered."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))


def components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node that has an edge; component is the smallest node reached.

    ``edges`` has two comparable columns u and v, in any order and with repeats; loops are ignored.
    Each round is two aggregations and two joins over the edges, written to the shared folder. A hub is
    only ever aggregated by ``min`` (combined before the shuffle) or joined (Spark splits skewed joins).
    Rounds grow with the logarithm of the longest chain. Empty edges give an empty table.
    """
    e = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges-0"
    )
    before = None
    for k in range(1, max_rounds + 1):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = large.where("u <> v").distinct()
        joined = large.join(_least(large), "u")
        small = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(
            joined.select("u", F.col("least").alias("v"))
        )
        new = scratch.save(small.where("u <> v").distinct(), f"edges-{k}")
        state = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        scratch.drop(f"edges-{k - 1}")
        e = new
        if tuple(state) == before:
            # stable: every node hangs on the least of its component
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
    raise RuntimeError("components did not settle")
