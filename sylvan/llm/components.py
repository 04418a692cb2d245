"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylvan.llm.common import materialise


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Each node u links (its larger | all other) neighbours to the least of its neighbourhood."""
    if larger_only:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if larger_only:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges (u, v), any order, repeats allowed -> (node, root): root is the least node of the component.

    Only nodes with an edge to another node appear. Every round is written to
    the shared folder; rounds end when the edges stay the same (count and an
    order-free checksum), by then each node points at its root. Groups are
    reduced to a minimum per node before they are joined again, so no
    neighbourhood is collected anywhere.
    """
    e = materialise(spark, edges.select("u", "v").where("u != v").distinct(), "cc")
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = None
    while (now := mark(e)) != was and now[0]:
        was = now
        e = materialise(spark, _star(_star(e, True), False), "cc")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
