"""Connected components of a distributed edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.store import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of ``edges`` (u, v: long); a component is named by its smallest node.

    In each round every node takes the smallest node among itself and its neighbours, jumps once along these, and
    the edges between different results go on. Minima are combined before the shuffle, so a node with very many
    neighbours is no burden, and no neighbour list is ever gathered. Self-loops, repeated and reversed edges are
    harmless; null ends are left out; no edges, no rows.
    """
    left = cut(edges.filter("u is not null and v is not null").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    label = None
    while True:
        both = left.select("u", "v").unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = cut(both.groupBy(F.col("u").alias("node")).agg(F.min(F.least("u", "v")).alias("to")), "hook")
        jump = hook.join(hook.select(F.col("node").alias("to"), F.col("to").alias("_next")), "to").select("node", F.col("_next").alias("to"))
        jump = cut(jump, "jump")
        if label is None:
            label = jump.select("node", F.col("to").alias("component"))
        else:
            later = jump.select(F.col("node").alias("component"), F.col("to").alias("_later"))
            label = cut(label.join(later, "component", "left").select("node", F.coalesce("_later", "component").alias("component")), "labels")
        a, b = jump.select(F.col("node").alias("u"), F.col("to").alias("_u")), jump.select(F.col("node").alias("v"), F.col("to").alias("_v"))
        moved = left.join(a, "u").join(b, "v").filter("_u <> _v")
        left = cut(moved.select(F.least("_u", "_v").alias("u"), F.greatest("_u", "_v").alias("v")).distinct(), "edges")
        if left.isEmpty():
            return label
