"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contraspark.llm.common import attach_stats, discard, materialise


def _star(edges: DataFrame, large: bool, most: int) -> DataFrame:
    """Large star: each node links its larger neighbours to its smallest neighbour. Small star: likewise the smaller ones.

    ``most`` bounds the links that a step looks at.
    """
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = attach_stats(both, ["a"], [F.min("b").alias("m")], F.col("b"), most=most)
        moved = near.where("b > a").select(F.least("a", "m").alias("a"), "b")
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        near = attach_stats(down, ["a"], [F.min("b").alias("m")], F.col("b"), most=most)
        moved = near.select(F.col("m").alias("a"), "b").union(near.select(F.col("m").alias("a"), F.col("a").alias("b")))
    return moved.where("a < b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (a, b: not null); a component is named by its smallest node.

    Each round is written to shared storage, so a lost executor costs one round. The number of rounds
    grows with the logarithm of the longest path.
    """
    edges = materialise(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = digest(edges)
    while True:
        old, edges = edges, materialise(_star(_star(edges, True, 2 * before[0]), False, 2 * before[0]), "edges")
        discard(old)
        now = digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
