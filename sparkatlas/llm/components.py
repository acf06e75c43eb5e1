"""Connected components of a distributed edge table by contraction under a random priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` longs -> ``(node, component)``, component the smallest node id reachable.

    Only nodes with an edge appear; loops, repeated and reversed edges are harmless, an edge with a null end is
    ignored, an empty table gives an empty one. Every round each node points to its neighbour of least hash (or to
    itself) and the graph is contracted along these pointers, which on average removes a constant share of the
    nodes, chains included. Partial aggregation takes the load off nodes of high degree. Nothing is collected.
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").selectExpr("a", "b")
    live = cut(both.union(both.selectExpr("b AS a", "a AS b")).distinct(), "edges")
    parents = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        best = live.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("b"))
        up = cut(best.select(F.col("a").alias("node"), F.least(F.col("m"), own)["b"].alias("up")), "up")
        parents.append(up)
        moved = (
            live.join(up.select(F.col("node").alias("a"), F.col("up").alias("pa")), "a")
            .join(up.select(F.col("node").alias("b"), F.col("up").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.col("pa").alias("a"), F.col("pb").alias("b"))
            .distinct()
        )
        before, live = live, cut(moved, "edges")
        drop_cut(before)
    else:
        raise RuntimeError("components did not converge")
    if not parents:
        return live.selectExpr("a AS node", "b AS component")
    root = parents[-1].selectExpr("node", "up AS root")
    for up in reversed(parents[:-1]):
        above = root.select(F.col("node").alias("up"), "root")
        root = up.join(above, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    root = cut(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return root.join(least, "root").select("node", "component")
