"""Connected components of an edge table by repeated hooking and contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkquarry.llm.tables import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b): root is the smallest node reachable.

    Each round every node hooks onto its smallest neighbour, the hooks are followed twice, and the
    edges are contracted to what still joins different trees.  Groups are only ever reduced with min(),
    so a hub of any degree is pre-aggregated before the shuffle.  No edges give no rows.
    """
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    mapping: DataFrame | None = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root"))
        hook = cut(_jump(_jump(hook)))
        mapping = hook if mapping is None else cut(_follow(mapping, hook))
        left, right = (hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
        moved = edges.join(left, "a").join(right, "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        edges = cut(moved.where("a < b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if mapping is None else mapping


def _jump(hook: DataFrame) -> DataFrame:
    """Every node to the root of its root."""
    return _follow(hook, hook)


def _follow(mapping: DataFrame, hook: DataFrame) -> DataFrame:
    """mapping with each root replaced by what hook says of it; a root that hook lacks stays."""
    onward = hook.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("onward"))
    return mapping.join(onward, "root", "left").select("node", F.coalesce("onward", "root").alias("root"))
