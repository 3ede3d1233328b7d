"""Connected components by contraction.

Each round gives every vertex its smallest neighbour as parent, follows the parents once more, and replaces the ends of all edges by
their parents. Edges inside one vertex vanish and equal edges merge, so the graph shrinks; a hub is an aggregate and
a join side with one row, never a list. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b), long, in any order, repeated or not. Gives (node, root) for every node that has an edge to another
    node; root is the smallest node of the component. Nulls and loops are ignored."""
    edges = edges.select("a", "b").dropna().filter("a <> b")
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("p"))
        up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        parent = stored(parent.join(up, "p").select("v", F.col("pp").alias("p")), "parents")
        if roots is None:
            roots = parent.select(F.col("v").alias("node"), F.col("p").alias("root"))
        else:
            moved = roots.join(parent.withColumnRenamed("v", "root"), "root", "left")
            roots = stored(moved.select("node", F.coalesce("p", "root").alias("root")), "roots")
        left = edges.join(parent.select(F.col("v").alias("a"), F.col("p").alias("x")), "a")
        left = left.join(parent.select(F.col("v").alias("b"), F.col("p").alias("y")), "b").filter("x <> y")
        edges = stored(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
