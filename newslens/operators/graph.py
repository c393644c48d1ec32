"""Graphs given as edge tables: connected components and minimum spanning forests, in rounds of joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newslens.session import cut_lineage

_INFER = "spark.sql.constraintPropagation.enabled"


def iterative(fn: Callable) -> Callable:
    """``fn(df, ...)`` without inferred constraints while it runs. A checkpoint keeps what was inferred about its columns;
    over many rounds of joins on renamed columns that grows until planning takes longer than running."""
    @wraps(fn)
    def run(df: DataFrame, *args, **kwargs):
        conf = df.sparkSession.conf
        before = conf.get(_INFER)
        conf.set(_INFER, "false")
        try:
            return fn(df, *args, **kwargs)
        finally:
            conf.set(_INFER, before)

    return run


def cut_round(df: DataFrame) -> DataFrame:
    """`cut_lineage` for rounds: the checkpoint also carries the measured size of its rows.

    A plain checkpoint keeps the size that was guessed for its plan, and a join's guess is the product of its sides'. Over
    rounds of joins the guess is squared again and again, until planning multiplies numbers of millions of digits. Rows
    that were cached once have a true size; the cache is given back as soon as they are written.
    """
    held = df.persist()
    try:
        held.count()
        return cut_lineage(held.select("*"))
    finally:
        held.unpersist()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *edges.columns[2:]))


def _jump(parents: DataFrame) -> DataFrame:
    """(node, root) from (node, parent), where roots are their own parents: every round doubles the steps taken, twice."""
    at = parents.select("node", F.col("parent").alias("root"))
    while True:
        for _ in range(2):
            on = at.select(F.col("node").alias("root"), F.col("root").alias("next"))
            at = at.join(on, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        at = cut_round(at)
        if at.where("moved").isEmpty():
            return at.select("node", "root")
        at = at.select("node", "root")


def _smallest(pairs: DataFrame) -> DataFrame:
    """(u, v, low): beside every pair the smallest of u and what stands beside it, by an aggregate that is joined back, so
    that the neighbours of one node are never gathered in one task."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return pairs.join(low, "u")


@iterative
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): ``root`` is the smallest node that is reachable.

    Rounds of two steps: every node links its larger neighbours to the smallest of its neighbourhood, then all its smaller
    ones and itself. Paths shorten until every node is linked to its root alone. NULL ends and loops are left out. Ends
    may be of any type that orders.
    """
    edges = cut_round(edges.where("a <> b").select("a", "b"))
    before = None
    while True:
        large = _smallest(_both_ways(edges.select("a", "b")).select(F.col("a").alias("u"), F.col("b").alias("v"))) \
            .where("v > u").select(F.greatest("v", "low").alias("u"), F.least("v", "low").alias("v")).where("u <> v").distinct()
        small = _smallest(large)
        edges = small.select(F.col("v").alias("a"), F.col("low").alias("b")) \
            .union(small.select(F.col("u").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()
        edges = cut_round(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return leaves.union(edges.select("b", "b").distinct())
        before = now


def _renamed(df: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """``df`` with the nodes of ``column`` replaced by the roots they moved to."""
    to = moves.select(F.col("node").alias(column), F.col("root").alias("_to"))
    return df.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).select(*df.columns)


@iterative
def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges (a, b, w) of a minimum spanning forest, by Borůvka's rounds; of equal weights the smaller ends win.

    In each round every component takes its lightest edge to another one; components that are joined become one, and of
    the edges between two components the lightest stays. The number of components at least halves.
    """
    weight = F.struct("w", "a", "b")
    known = edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("w").alias("w"))
    left = cut_round(known.select(F.col("a").alias("x"), F.col("b").alias("y"), weight.alias("e")))
    taken = []
    while not left.isEmpty():
        ends = left.select("x", "y", "e").union(left.select(F.col("y").alias("x"), F.col("x").alias("y"), "e"))
        best = cut_round(ends.groupBy("x").agg(F.min(F.struct("e", "y")).alias("m")).select("x", "m.y", "m.e"))
        taken.append(best.select("e.*").distinct())
        # edges are totally ordered, so only two components can take the same edge: the smaller of them is the root
        back = best.select(F.col("x").alias("y"), F.col("y").alias("z"))
        hooks = best.join(back, "y", "left").select(F.col("x").alias("node"), F.when(
            (F.col("z") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("parent"))
        moves = _jump(cut_round(hooks))
        left = _renamed(_renamed(left, moves, "x"), moves, "y").where("x <> y")
        left = cut_round(left.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("e").alias("e")))
    forest = edges.select("a", "b", "w").limit(0)
    for t in taken:
        forest = forest.unionByName(t.select("a", "b", "w"))
    return forest
