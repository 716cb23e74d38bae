"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windowlab.llm.store import stored


def jump(parents: DataFrame) -> DataFrame:
    """Pointer jumping: (node, parent) with parent < node or equal becomes (node, root)."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        nxt = stored(parents.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent"), (F.coalesce("above", "parent") != F.col("parent")).alias("moved")), "jump")
        moved = nxt.filter("moved").limit(1).count()
        parents = nxt.select("node", "parent")
        if not moved:
            return parents


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable; only nodes that have a link appear.

    Every round hooks each node to its smallest neighbour, compresses the trees by pointer jumping and contracts the
    links; the number of nodes with links at least halves, so rounds are few and no table of a component is gathered.
    """
    left = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    labels = None
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent"))
        roots = jump(stored(hooks, "hooks"))
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            labels = stored(labels.join(up, "parent", "left").select("node", F.coalesce("above", "parent").alias("parent")), "labels")
        a = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        left = stored(left.join(a, "a").join(b, "b").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).filter("a <> b").distinct(), "links")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels.select("node", F.col("parent").alias("root"))
