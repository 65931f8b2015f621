"""Connected components of a link table by alternating star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barframe.session import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the smallest of them: those above the vertex (large), or the vertex and those below it."""
    both = edges.select("a", "b")
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``vertex, root`` for every vertex of the links ``a, b`` (longs); root is the component's smallest vertex.

    Every round is a stored table; the number of rounds grows with the logarithm of the number of vertices.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, before = materialise(links, "links"), None
    while True:
        # Equal sums of a hash over all links mean that the round changed nothing.
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        current = materialise(_star(_star(current, True), False), "links")
    roots = current.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("vertex"), F.col("b").alias("root")).unionByName(roots)
