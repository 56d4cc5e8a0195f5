"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.llm.shared import drop_stage, staged


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Each round every node points to the first of itself and its neighbours in an order drawn anew (a hash of
    node and round), pointers are followed twice, and the edges are drawn between the targets. In a random
    order a constant share of the nodes are targets, whatever the shape of the graph, so the rounds grow with
    the logarithm of the largest component; the loop ends when no edge is left. Neighbours are combined before
    the shuffle, so a node with many edges is no hot key. Rounds are staged in the shared folder: nothing is
    recomputed after the loss of an executor.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e, old_e = staged(edges.where("a <> b").select("a", "b").distinct(), "cc-edges")
    labels, old_l, turn = None, None, 0
    while not e.isEmpty():
        turn += 1
        ranked = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        p, path_p = staged(both(e).groupBy("a").agg(F.min(ranked("b")).alias("m"))
                           .select(F.col("a").alias("node"), F.least(ranked("a"), "m")["n"].alias("to")), "cc-point")
        q = p.select(F.col("node").alias("to"), F.col("to").alias("to2"))
        hop, path_h = staged(p.join(q, "to", "left").select("node", F.coalesce("to2", "to").alias("to")), "cc-hop")
        nxt = (e.join(hop.select(F.col("node").alias("a"), F.col("to").alias("x")), "a")
                .join(hop.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
                .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        new_l = (hop.select("node", F.col("to").alias("root")) if labels is None else
                 labels.join(hop.select(F.col("node").alias("root"), "to"), "root", "left")
                       .select("node", F.coalesce("to", "root").alias("root")))
        e2, path_e = staged(nxt, "cc-edges")
        l2, path_l = staged(new_l, "cc-labels")
        for path in (old_e, old_l, path_p, path_h):
            if path:
                drop_stage(spark, path)
        e, old_e, labels, old_l = e2, path_e, l2, path_l
    if labels is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    names = labels.groupBy("root").agg(F.min("node").alias("component"))
    return labels.join(names, "root").select("node", "component")
