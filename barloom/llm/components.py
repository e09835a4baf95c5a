"""Connected components of a graph given as an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import cut_lineage, join_by_weight


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """Each node's larger (or smaller and own) neighbours are linked to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    moved = join_by_weight(both, least, ["a"], "n", total)
    if large:
        out = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return cut_lineage(out.where(F.col("a") != F.col("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root) for every node of an edge, root being the least node of its component.

    A null end is no node, and its edge is left out. Steps alternate until they change nothing; each is
    checkpointed. The edges of a node with very many neighbours stay spread over the tasks.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    told = edges.agg(*state).first()
    while told[0]:
        edges = _star(_star(edges, True, 2 * told[0]), False, told[0])
        now = edges.agg(*state).first()
        if now == told:
            break
        told = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
