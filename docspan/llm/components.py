"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspan.operators.storage import stored


def _sum(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row.n, int(row.s or 0)


def _large(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node goes to the node's least neighbour (itself included)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")).withColumnRenamed("a", "u")
    return both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, go to the least of them. Edges run from the larger (a) to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = edges.join(least, F.col("a") == F.col("u"))
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node of ``edges`` (a, b) but the roots themselves.

    Nodes are longs. Self-loops and repeated edges are allowed; nulls are not. Every round is written to the shared folder,
    so a lost executor costs one round; the driver sees two numbers a round. The rounds grow with the logarithm of the longest
    chain. No edges give no rows."""
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    seen = _sum(now)
    while seen[0]:
        now = stored(_small(_large(now)), "edges")
        state = _sum(now)
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
