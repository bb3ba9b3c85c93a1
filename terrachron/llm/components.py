"""Connected components of a large edge list, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(edges: DataFrame) -> DataFrame:
    """Each node of ``edges`` (u, v) with the smallest node next to it, itself included."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node now hang on the smallest node next to it."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (
        both.where("v > u")
        .join(_stars(edges), "u")
        .where("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node itself, hang on the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(u, component) of every node of an edge list (u, v) of numbers: the smallest node it reaches.

    Rounds of large-star and small-star contractions, logarithmic in the longest path, each written
    to the shared folder, until an edge list stays as it is. Self-loops and repeated edges are
    allowed; nodes with only a self-loop are their own component. No node's neighbours are gathered.
    """
    loops = edges.where("u = v").select("u", F.col("v").alias("component"))
    now = written(edges.where("u <> v").select("u", "v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        now = written(_small(_large(now).distinct()).distinct())
    found = now.groupBy("u").agg(F.min("v").alias("component"))
    roots = found.select(F.col("component").alias("u"), "component").distinct()
    return loops.unionByName(found).unionByName(roots).groupBy("u").agg(F.min("component").alias("component"))
