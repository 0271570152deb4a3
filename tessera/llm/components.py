"""Connected components in Spark, by alternating large and small stars.

Labels never come to the driver; each round writes its edges to the shared
folder, so lineage stays short and a lost executor costs a re-read. A hub's
neighbours meet its smallest one through a join that can be split, not in one
group. Rounds end as soon as all edges are stars: one more, to see that nothing
changes, would be as many plans and tasks for the driver as any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import common


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable, itself included) of each node in edges (a, b: long)."""
    big, small = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    e = common.written(edges.where("a <> b").select(big, small).distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u > v").distinct()
        large = common.written(large)
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(first, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = common.written(first.select("u", F.col("m").alias("v")).unionByName(rest).distinct())
    linked = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return linked.unionByName(e.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root")))


def _are_stars(e: DataFrame) -> bool:
    """Whether each edge (u > v, each once) leads from a node with no other edge to the smallest of its component."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x"))
    by = ends.groupBy("x.node").agg(F.sum("x.down").alias("down"), F.max("x.up").alias("up"))
    return by.where("down > 1 or down = 1 and up = 1").isEmpty()
