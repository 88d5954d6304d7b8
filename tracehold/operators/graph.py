"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round is grouping and joining by key; hot keys are pre-aggregated by the
grouping and split by adaptive joins.  Rounds grow with the logarithm of the
number of nodes.  Every round's edges are a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracehold.session import stage


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link neighbours of each node to the smallest one around it: those above the node, or those not above."""
    both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else pairs
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if larger:
        out = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    ``edges`` has two columns of one type.  Null ends and loops link nothing;
    repeated edges count once; no edges give no rows.
    """
    a, b = edges.columns
    current = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current, mark = stage(current.distinct(), "edges"), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == mark or not now[0]:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(current.select("v", "v").distinct())
        mark = tuple(now)
        current = stage(_star(_star(current, True), False), "edges")
