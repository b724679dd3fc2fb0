"""Connected components of a link table by minimum-parent contraction.

Every link points from the larger to the smaller id. A round keeps each node's smallest parent,
links its other parents to that one, and jumps over parents that have one themselves; it ends
when every parent is a root. Only link tables move; the state of each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links: (a, b). Returns (node, component) for every node with a link except the roots themselves."""
    edges = cut(
        links.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent"))
        .distinct()
    )
    while True:
        # checkpointed, so that the joins below shuffle it plainly and hot parents can be split
        least = cut(edges.groupBy("child").agg(F.min("parent").alias("least"), F.max("parent").alias("most")))
        up = least.select(F.col("child").alias("parent"), F.col("least").alias("upper"))
        forest = least.filter(F.col("least") != F.col("most")).isEmpty()
        if forest and least.join(up, least["least"] == up["parent"], "left_semi").isEmpty():
            return least.select(F.col("child").alias("node"), F.col("least").alias("component"))
        pulled = edges
        if not forest:
            joined = edges.join(least.select("child", "least"), "child")
            pulled = joined.select("child", F.col("least").alias("parent")).unionByName(
                joined.filter(F.col("parent") != F.col("least")).select(F.col("parent").alias("child"), F.col("least").alias("parent"))
            ).distinct()
        jumped = pulled.join(up, "parent", "left").select("child", F.coalesce("upper", "parent").alias("parent"))
        edges = cut(jumped.filter(F.col("child") != F.col("parent")).select(F.greatest("child", "parent").alias("child"), F.least("child", "parent").alias("parent")).distinct())
