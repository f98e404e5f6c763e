"""Connected components of an edge table, by alternating large and small stars.

Each round turns the edges of every vertex towards its smallest neighbour; rounds are logarithmic in practice.
Joins are on vertices and hold one row a vertex on one side, so a hub is a skewed join that adaptive execution
splits. Lineage is cut by checkpoint() after every round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component): each vertex of edges (a, b) and the smallest vertex that it reaches. Nulls are ignored."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
