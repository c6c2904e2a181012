"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours on to the least of its neighbours and itself."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionByName(up).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node joins its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is its least node that can be reached.

    Large-star and small-star steps in turn until each component is one star; their number grows with the logarithm of a
    component's size. The least neighbour is a partial aggregate, so a node with very many edges is not gathered
    anywhere, and its join splits as a skewed one. Null nodes, and edges from a node to itself, count as none.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state, before = None, edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while before[0] and state != before:
        state = before
        edges = materialize(_small_star(_large_star(edges)))
        before = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
