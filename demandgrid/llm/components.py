"""Connected components of an edge table by alternating star steps.

Each step is a group minimum and a join over edges, so no task holds a component and a hub's
rows can be split between tasks. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node with an edge to another; component is its smallest node.

    Direction, repeats and self-loops of edges do not matter; rows with a null end are ignored.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct()
    e = materialize(e, "edges")
    while True:
        e = materialize(_small_star(_large_star(e)), "stars")
        parents = e.select(F.col("v").alias("u")).distinct()
        # a star forest: one parent each, and no parent is a child
        chained = e.join(parents, "u", "left_semi").limit(1).count()
        if not chained and not e.groupBy("u").count().where("count > 1").limit(1).count():
            break
    children = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return children.union(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Each node's larger neighbours are tied to its smallest neighbour or itself."""
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.join(least, "u").where("v > u")
    return tied.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of those."""
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
