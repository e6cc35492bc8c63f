"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its least neighbour to its larger neighbours (large) or to its smaller ones and itself."""
    if large:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.min("v").alias("m"))
    joined = seen.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    else:
        out = joined.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        out = out.union(least.select("u", "m"))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges(a, b); root is the least node of the component. Order follows the ids' type.

    No group is gathered: hot nodes only meet their least neighbour, in a join that Spark can split.
    """
    edges = checkpointed(edges.select("a", "b").where("a <> b").distinct())
    before = _state(edges)
    while before[0]:
        edges = checkpointed(_star(_star(edges, True), False))
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
