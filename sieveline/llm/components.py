"""Connected components of an edge table, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import remove, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every vertex of the edges with the smallest vertex it reaches.

    Edges are (a, b) of bigint. Repeated edges, loops and nulls are allowed
    (a null end drops the edge). Each round hooks every vertex to the smallest
    label in its neighbourhood and rewrites the edges onto labels, so a star
    vanishes in one round and a path shrinks by half or more; edges within one
    label are dropped. Only vertices and edges in shared tables are kept
    between rounds. Returns (vertex, component); no edges give no rows.
    """
    e = stored(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "edges")
    spark = edges.sparkSession
    labels = None
    while True:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("w")).union(e.select("b", "a"))
        # each vertex points to its smallest neighbour or itself; every vertex has an edge
        hook = both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("up"))
        hook = stored(hook, "hooks")
        # vertices that point to one that points further down take that one
        nxt = hook.select(F.col("v").alias("up"), F.col("up").alias("up2"))
        hook2 = stored(hook.join(nxt, "up").select("v", F.col("up2").alias("up")), "hooks")
        remove(spark, hook)
        if labels is None:
            new = hook2.select("v", F.col("up").alias("label"))
        else:
            up = hook2.select(F.col("v").alias("label"), "up")
            new = labels.join(up, "label", "left").select("v", F.coalesce("up", "label").alias("label"))
        new = stored(new, "labels")
        if labels is not None:
            remove(spark, labels)
        labels = new
        l1, l2 = hook2.select(F.col("v").alias("a"), F.col("up").alias("la")), hook2.select(F.col("v").alias("b"), F.col("up").alias("lb"))
        e2 = e.join(l1, "a").join(l2, "b").where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
        e2 = stored(e2, "edges")
        remove(spark, e)
        remove(spark, hook2)
        e = e2
        if e.isEmpty():
            return labels.select(F.col("v").alias("vertex"), F.col("label").alias("component"))
