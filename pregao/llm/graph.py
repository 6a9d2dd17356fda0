"""Connected components of an undirected graph, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pregao.session import materialise


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges u-v (both directions) with ``m``, the least of u and its neighbours.

    The least is pre-aggregated per task, and a node with very many edges is an
    ordinary skewed key of the join, which adaptive execution splits.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v); a component is named by its least node.

    Alternates two steps until nothing changes: each node ties its larger neighbours
    to the least node it knows, then its smaller ones. Both keep the components and end
    in stars around the least nodes, in a number of rounds that grows with the logarithm
    of the graph. Every round is a written table, so a lost executor costs one round at
    most; only a count and a checksum per round reach the driver. Self loops and null ends
    are left out; repeated edges count once.
    """
    kept = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), label
    )
    seen = None
    while True:
        state = kept.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen or state[0] == 0:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        both = kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # Here u > v holds for every edge, so the neighbours of u are its smaller ones.
        tied = _least_neighbour(large)
        small = tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = large.groupBy("u").agg(F.min("v").alias("v"))
        kept = materialise(small.unionByName(own).distinct(), label)
