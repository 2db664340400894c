"""Connected components of a graph held as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shared


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every vertex of the edges (``a``, ``b``); root is the smallest id reachable.

    Each round takes the least root among the neighbours and then follows the root's own root, so that chains
    halve; rounds end when nothing changes. Every round is checkpointed in the shared folder. Links and roots
    never leave the executors. Loops and repeated edges are harmless; ends must not
    be null. Without edges there are no rows."""
    shared.shared_dir(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    roots = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")).checkpoint()
    while True:
        near = both.join(roots, both.b == roots.id).groupBy("a").agg(F.min("root").alias("m"))
        least = roots.join(near, roots.id == near.a, "left").select("id", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        up = roots.select(F.col("id").alias("up"), F.col("root").alias("above"))
        after = least.join(up, least.root == up.up, "left").select("id", "was", F.least("root", F.coalesce("above", "root")).alias("root")).checkpoint()
        roots = after.select("id", "root")
        if after.filter("was <> root").isEmpty():
            return roots
