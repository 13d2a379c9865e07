"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node go to the smallest of it and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, go to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _single(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour only."""
    return edges.groupBy("u").count().where("count > 1").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node root`` for every node with an edge to another; ``root`` is the
    smallest node that it reaches. Only edge rows are moved, a node's neighbours
    are never gathered, and each round is written to the shared folder."""
    turned = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, mark = saved(turned), None
    while True:
        now = saved(_small_star(_large_star(now)))
        # Stars are the end: no node is between two others, none has two roots.
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty() and _single(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            )
        mark = tuple(seen)
