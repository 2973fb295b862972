"""Connected components by alternating stars, a few joins per round.

Large star: every node hands the least of its neighbourhood to its larger neighbours.
Small star: every node hands the least of its smaller neighbours to the others.  Rounds go
on until the edges no longer change; then every edge joins a node to the least node of its
component.  Rounds grow with the logarithm of the number of nodes.  Nodes of any degree
are met by ``attach``; every round is a written table, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, settled

MAX_ROUNDS = 64


def _least(edges: DataFrame) -> DataFrame:
    """Every edge (u, v) with the least of u and its neighbours as ``m``."""
    least = settled(
        edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least"
    )
    return attach(edges, least, "u", "n", ["v", "u"], F.col("m"), "m").withColumn(
        "m", F.least("u", "m")
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v); the component is its least
    node."""
    now = settled(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settled(large.where("u <> v").distinct(), "large")
        seen = _least(large)
        small = seen.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(seen.select("u", F.col("m").alias("v")))
        now = settled(small.where("u <> v").distinct(), "small")
        mark = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if before == mark:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
