"""Connected components by alternating large-star and small-star rounds; each round is a written table.

Nothing about documents reaches the driver but a row count and a checksum per round. A hub's edges are joined with one
row, its minimum, which comes from partial aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import discard, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node and label, the least node of its component, for every node with an edge."""
    now = staged(edges.select("a", "b").where("a <> b").distinct(), "edges")
    told = None
    while True:
        was, now = now, staged(_star(_star(now, True), False), "stars")
        discard(was)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == told:
            break
        told = state
    # now every edge points at the least node of its component
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
    out.staged_at = now.staged_at  # discard() takes it
    return out
