"""Connected components of a link table as joins and minima, one checkpoint a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genospan.llm.runtime import cut


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node that has a link; the component is its smallest node.

    Alternates the large-star and small-star steps: each node points its larger
    neighbours, then its smaller ones, to the least node it knows.  The number of
    rounds grows with the logarithm of the longest path.  A hub is a key of
    plain joins and partial minima only, which Spark splits and combines.
    """
    ends = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    edges, mark = cut(ends.distinct()), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).union(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct())
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small_min, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.union(small_min.select("u", F.col("m").alias("v"))).distinct())
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
