"""Connected components of an edge table, with nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekwell.session import materialize

#: A node's edges are dealt to this many tasks, so one with very many fills none.
SALTS = 16


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and all its neighbours v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(copies, ["u", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); a component is named by its least node.

    Alternates the large-star and small-star steps: larger neighbours, then smaller ones, are linked to the least
    neighbour until only stars around the least nodes remain. Steps grow with the logarithm of the longest path.
    """
    links = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = F.col("m").alias("v")
        near = F.explode(F.array_distinct(F.array("u", "v"))).alias("u")
        links = materialize(_with_least(large).select(near, least).where("u <> v").distinct())
