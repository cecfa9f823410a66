"""Connected components of a large graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysieve.llm.common import written


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node, linked with the smallest of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours, linked with the smallest of them. Edges go from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` of all nodes that have an edge; the component is its smallest node.

    Edges are ``(a, b)`` in any direction; loops and repeated ones do no harm. Each
    round is a written table; the number of rounds grows with the logarithm of the
    graph's size. The driver sees two numbers per round.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    ordered = written(ordered, "links")
    before = state(ordered)
    while before[0]:
        ordered = written(small_star(large_star(ordered)), "links")
        after = state(ordered)
        if after == before:
            break
        before = after
    roots = ordered.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return ordered.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots)
