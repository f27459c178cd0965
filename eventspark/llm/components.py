"""Connected components of a link table by alternating large and small stars.

Each step is a grouped minimum (combined before the shuffle) joined back to
the links, so a node with very many links is neither collected nor processed
in one task. The number of steps grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventspark.llm.common import Workspace


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, ws: Workspace, name: str = "cc") -> DataFrame:
    """``links`` (a, b) of any orderable type -> (node, component), where the
    component is its smallest node; nodes without links do not appear. Loops
    and repeated links are harmless; null ends are ignored."""
    edges = links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = ws.save(edges, f"{name}-0")
    seen, step = _state(edges), 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = ws.save(large, f"{name}-{step}-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        step += 1
        new = ws.save(moved.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{step}")
        ws.drop(f"{name}-{step - 1}", f"{name}-{step - 1}-large")
        edges, state = new, _state(new)
        if state == seen:
            break
        seen = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
