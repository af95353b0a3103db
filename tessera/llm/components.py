"""Connected components of an edge table by hooking, pointer jumping and contraction.

Only equi-joins and partially aggregated group-bys: a vertex with a third of all edges is a skewed
join, which adaptive execution splits, and never a list in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, stored


def _jump(hooks: DataFrame) -> DataFrame:
    """Follow parents until each row names its root; every parent is smaller than its child."""
    while True:
        up = hooks.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        before = hooks
        hooks = stored(before.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), "jump")
        release(before)
        if hooks.where("moved").isEmpty():
            return hooks.select("v", "p")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any one orderable type -> ``(v, root)`` for each vertex that isn't its root.

    ``root`` is the smallest vertex of the component. Self-loops and nulls are ignored; repeated
    edges count once; an empty table gives an empty one.
    """
    pairs = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = stored(pairs.distinct(), "edges")
    labels = None
    while not pairs.isEmpty():
        hooks = _jump(pairs.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p")))
        if labels is None:
            labels = hooks.select("v", F.col("p").alias("root"))
        else:
            step = hooks.select(F.col("v").alias("root"), "p")
            old = labels.join(step, "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            labels = old.unionByName(hooks.select("v", F.col("p").alias("root")))
        left, right = hooks.select(F.col("v").alias("a"), F.col("p").alias("pa")), hooks.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = pairs.join(left, "a", "left").select(F.coalesce("pa", "a").alias("a"), "b")
        moved = moved.join(right, "b", "left").select("a", F.coalesce("pb", "b").alias("b")).where("a <> b")
        before = pairs
        pairs = stored(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        release(before)
    return pairs.select(F.col("b").alias("v"), F.col("a").alias("root")) if labels is None else labels
