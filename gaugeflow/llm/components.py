"""Connected components of an edge table, by alternating stars over Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow.llm.shared import release, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of (u bigint, v bigint): component is the smallest node that can be reached.

    Each round joins every node's larger neighbours to its smallest one, then its smaller ones; edges never grow in number by more
    than the nodes. The edges given are read once. The rounds end when the edges are stars. Self-loops, repeated edges and either direction are allowed;
    edges with a null end are left out. Every round is written to the shared folder, and so is what a hub's edges are joined with: an
    aggregate beside the join would hold them in one task.
    """
    edges = edges.where("u is not null and v is not null")
    given = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    now, loops, old = given.where("u <> v"), given.where("u = v"), []
    # Stars: each node has one edge, and no node that an edge leads to has one itself.
    while now.join(now.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count() or now.groupBy("u").count().where("count > 1").limit(1).count():
        # Large star: neighbours above u go to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        own = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
        large = both.where("v > u").join(own, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its neighbours below it go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for df in (own, *old):  # nothing reads the round before any more
            release(df)
        old = [now]
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
