"""Connected components of an edge table, with DataFrame operations only.

Alternating star rounds: the large-star step links every larger neighbour of a node to the
smallest node of its neighbourhood, the small-star step does so with the node and its smaller
neighbours. Both keep the components; the rounds end when the edges are stars around the
smallest node of each component. Every step is a grouped minimum (combined before the shuffle)
and a join that deals out hot nodes, and is written to the shared folder, so neither a hub nor
a lost executor stops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import Scratch, skew_join


def _digest(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("big"))  # u < big
    return (skew_join(larger, low, "u", F.col("big"))
            .select(F.col("big").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = (skew_join(edges, low, "u", F.col("v")).filter("v <> m")
             .select(F.col("v").alias("u"), F.col("m").alias("v")))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b",
                         name: str = "cc", max_rounds: int = 100) -> DataFrame:
    """(node, label): ``label`` is the smallest node reachable from ``node``, itself included.

    Nodes are those of ``edges``; rows with a null end give none; repeated edges and loops are
    allowed. An empty table gives an empty one. Raises if ``max_rounds`` rounds don't converge.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    whole = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = scratch.table(whole.filter(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct(), f"{name}-0")
    seen = _digest(e)
    if seen[0]:
        for k in range(1, max_rounds + 1):
            e = scratch.table(_large_star(e), f"{name}-{k}l")
            e = scratch.table(_small_star(e), f"{name}-{k}s")
            now = _digest(e)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components did not converge in {max_rounds} rounds")
    loops = whole.filter(F.col(a) == F.col(b)).select(F.col(a).alias("node"), F.col(a).alias("label"))
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    hubs = e.select(F.col("v").alias("node"), F.col("v").alias("label"))
    return stars.unionByName(hubs).unionByName(loops).groupBy("node").agg(F.min("label").alias("label"))
