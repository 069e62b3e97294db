"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def _large_star(edges: DataFrame, work: Workspace, name: str, rows: int) -> DataFrame:
    """Every larger neighbour of u is linked to u's smallest neighbour (or u)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    least = work.materialize(least, name, rows)  # written before it is joined, so that a hot node's edges can be split
    return both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, work: Workspace, name: str, rows: int) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them. Edges have u > v."""
    least = work.materialize(edges.groupBy("u").agg(F.min("v").alias("m")), name, rows)
    down = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node without one: nothing is left to join."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v), component being the
    smallest node reachable. Loops and repeated edges do no harm; nodes and
    edges are never gathered in one place, and a node with very many edges is
    reduced by partial minima. An empty table gives an empty one."""
    now = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, step = work.materialize(now, f"{name}-0"), 0
    while not _stars(now):
        step += 1
        rows = 2 * now.count()
        large = work.materialize(_large_star(now, work, f"{name}-least-{step}", rows), f"{name}-large-{step}", rows)
        now = work.materialize(_small_star(large, work, f"{name}-small-{step}", rows), f"{name}-{step}", rows)
        work.drop(f"{name}-{step - 1}", f"{name}-least-{step}", f"{name}-large-{step}", f"{name}-small-{step}")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
