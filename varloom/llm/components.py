"""Connected components of a table of links by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.plans.scale import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for each linked node the smallest node that can be reached.

    Large-star links every larger neighbour of a node to the smallest one among the node and
    its neighbours; small-star does the same for smaller neighbours and the node itself. Both
    are a minimum by node joined back to the links, so that no node's neighbours meet in one
    task. The rounds end when they change nothing. NULL ends and links of a node to itself
    are left out; repeated links count once; without links there are no rows.
    """
    node = F.least(a, b), F.greatest(a, b)
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges = cut_lineage(edges.select(node[0].alias("lo"), node[1].alias("hi")).distinct())
    print_of = F.struct(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")))
    before = None
    while (now := edges.agg(print_of.alias("p")).first().p) != before:
        before = now
        edges = cut_lineage(_small_star(_large_star(edges)), replaces=edges)
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).union(
        edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
        edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).join(least, "u")
    return larger.select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.union(least.select(F.col("m").alias("lo"), "hi")).distinct()
