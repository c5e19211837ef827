"""Connected components by alternating stars; all steps are joins and aggregates, written out after each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialise


#: Edges below which joins read their aggregates directly; above, these are written out first.
FEW_EDGES = 100_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node above has one node below, which has none itself."""
    ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("ups"), F.lit(0).alias("downs")).unionByName(edges.select(F.col("u").alias("x"), F.lit(0).alias("ups"), F.lit(1).alias("downs")))
    return ends.groupBy("x").agg(F.sum("ups").alias("ups"), F.max("downs").alias("downs")).filter("ups > 1 or (ups = 1 and downs = 1)").isEmpty()


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node that edges (u, v) of longs touch; root is the smallest id of its component.

    Each round links the neighbours above a node to its smallest neighbour (large star), then the neighbours below
    to theirs (small star), until every component is one star. Rounds grow with the
    logarithm of a component's width. Self-links and repeated links are harmless; rows with nulls are left out.
    """
    current = materialise(_ordered(edges), "edges")
    while not _are_stars(current):
        # Written out, both sides of a join are plain scans: then Spark splits the rows of a hub that many touch.
        settle = materialise if current.count() > FEW_EDGES else lambda df, _: df
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
        large = _ordered(both.filter("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = materialise(large, "large-star")
        below = settle(large.groupBy("v").agg(F.min("u").alias("m")).withColumnRenamed("v", "w"), "below")
        moved = large.join(below, F.col("v") == F.col("w")).filter("u <> m").select("u", F.col("m").alias("v"))
        current = materialise(_ordered(moved.unionByName(below.select(F.col("w").alias("u"), F.col("m").alias("v")))), "small-star")
    roots = current.select(F.col("u").alias("id")).distinct().withColumn("root", F.col("id"))
    return current.select(F.col("v").alias("id"), F.col("u").alias("root")).unionByName(roots)
