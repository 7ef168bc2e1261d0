"""Connected components by alternating large-star and small-star steps.

Every step joins each vertex's edges with the least vertex near it; the result is a written
table, so lineage stays short and a lost executor costs one step. Vertices with very many
edges only ever meet a one-row-per-vertex table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has both directions (large) or only towards smaller vertices (small)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("least", "a"))
    met = salted_join(edges, least, ["a"])
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component: its least id) of every vertex of (a, b) that has an edge to another."""
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        wide = written(_stars(both, True), "edges")
        now = written(_stars(wide, False), "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
