"""Connected components of a graph of links, by alternating star operations.

Each round turns every node's neighbourhood into a star around its smallest
member: first among larger neighbours, then among smaller ones. Minima are
aggregates with partial results on the map side, so a node with very many links
is no single task's work; after about log(n) rounds every component is a star
around its smallest node. Each round is written to the shared folder, and so are the
minima: a join of two written tables is one that adaptive execution can split
where a node has many links, or broadcast where the graph is small. A round is
written in as many parts as its counted links ask for, ``ROWS`` each, so the last
rounds of a large graph are not thousands of empty tasks, and no part grows with
the graph. What a round has read is deleted when the next one is written.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget

ROWS = 100_000


def _large(edges: DataFrame, parts: int) -> DataFrame:
    """Every edge once, its larger end now linked to the smallest node around the smaller end."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = cut(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")).coalesce(parts), "stars")
    out = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(parts), "large-stars")
    forget(least)
    return out


def _small(edges: DataFrame, parts: int) -> DataFrame:
    """Smaller neighbours of a node, and the node, linked to the smallest of them."""
    near = cut(edges.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "stars")
    moved = edges.join(near, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
    out = cut(moved.where("u != v").distinct().coalesce(parts), "links")
    forget(near)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``component``, the smallest id reachable, of every node of links (``u``, ``v``)."""
    high, low = F.greatest("u", "v"), F.least("u", "v")
    edges = cut(links.where("u != v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    for _ in range(rounds):
        parts = math.ceil(2 * edges.count() / ROWS) or 1
        large = _large(edges, parts)
        after = _small(large, parts)
        forget(edges, large)
        edges = after
        ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("lower"), F.lit(0).alias("upper")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("lower"), F.lit(1).alias("upper")))
        odd = ends.groupBy("id").agg(F.sum("lower").alias("a"), F.max("upper").alias("b")).where("a > 1 OR (a = 1 AND b = 1)")
        if odd.isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
