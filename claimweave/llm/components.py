"""Connected components by exchange of smallest neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.common import stage


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b; any ordered type) → node, root (smallest node of its component), for nodes that have an edge.

    Large star and small star in turn, minima aggregated before the shuffle and written before they are joined, so that
    the edges of a hub are dealt to several tasks. Each round is written; the rounds end when every node but the roots
    has one edge, and that to a root.
    """
    state = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    def large(e: DataFrame) -> DataFrame:
        near = e.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = stage(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-low")
        return near.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()

    def little(e: DataFrame) -> DataFrame:
        low = stage(e.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        moved = e.join(low.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    while True:
        state = stage(little(stage(large(state), "components")), "components")
        by_node = state.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("top"))
        if by_node.where("v <> top").isEmpty() and state.join(state.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            break
    top = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(top)
