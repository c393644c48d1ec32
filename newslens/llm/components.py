"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.llm.common import cut_lineage


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) with the smallest of u's closed neighbourhood beside each: a partial aggregate joined back, so a node
    with very many neighbours is never gathered in one task."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return pairs.join(low, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")) \
        .union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("a"), F.col("low").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    near = _star(down)
    return near.select(F.col("v").alias("a"), F.col("low").alias("b")) \
        .union(near.select(F.col("u").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): ``root`` is the smallest node of its component.

    Each round shortens all paths; it ends when a round changes nothing. NULL ends and loops are left out. The edges
    of every round are checkpointed in the shared folder, which cuts the lineage.
    """
    edges = cut_lineage(edges.where("a <> b").select("a", "b"))
    state = None
    while True:
        edges = cut_lineage(_small(_large(edges)))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")),
                        F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
