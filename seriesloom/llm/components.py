"""Connected components of a graph held in Spark: rounds of large-star and small-star.

Each round is two shuffles of the edges with map-side minima, written to the shared folder. A
vertex with very many neighbours is met through minima and joins only, never through a list of them.
Rounds end when the edges are stars; their number grows with the logarithm of the size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, comp: every vertex of the edges (a, b longs) with the smallest vertex it is connected to."""
    now = base.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # every larger neighbour of a vertex, and the vertex, joins the smallest around it
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        mins = large.groupBy("a").agg(F.min("b").alias("m"))
        # every smaller neighbour of a vertex joins the smallest of them
        small = large.join(mins, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mins.select("a", F.col("m").alias("b"))).where("a > b").distinct()
        now = base.stored(small, name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("comp"))).distinct()
