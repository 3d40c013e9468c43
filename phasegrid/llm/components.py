"""Connected components by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.common import cut, forget


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its neighbours (large: those above it;
    small: those below it) to the least of itself and its neighbours.

    The least neighbour is found by an aggregate that combines before its
    shuffle. It is joined back on the complement of the node's number, so that
    both sides are dealt out for the join and a node with very many neighbours
    can be split between tasks."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
    near = both.withColumn("k", F.bitwise_not("u")).join(least, "k")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60) -> DataFrame:
    """node and root (the least node reachable) of every node on an edge.

    edges: pairs of long ids in either order; loops and repeats do no harm,
    nulls are no edges. A node without an edge to another isn't returned. Each
    round is written to the shared folder."""
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, seen = cut(now), None
    for _ in range(most):
        state = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 1))")).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        before, now = now, cut(_stars(_stars(now, True), False))
        forget(before)
    else:
        raise RuntimeError(f"components still change after {most} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def label(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component_id (the least id of the nodes that edges connect with
    it) and group_ (a number of that component) of the nodes that have an edge
    or copies. nodes: node (once), least (id of its rows) and copies."""
    found = components(edges).select(F.col("node").alias("n_"), "root")
    rooted = nodes.join(found, F.col("node") == F.col("n_"), "left").filter("root IS NOT NULL OR copies > 1")
    rooted = rooted.select("node", "least", F.coalesce("root", "node").alias("root_"))
    ids = rooted.groupBy(F.bitwise_not("root_").alias("k_")).agg(F.min("least").alias("component_id"))
    # Joined on the complement, so that both sides are dealt out for the join.
    return rooted.withColumn("k_", F.bitwise_not("root_")).join(ids, "k_").select("node", "component_id", F.col("root_").alias("group_"))
