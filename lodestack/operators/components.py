"""Connected components by rounds of least labels, with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled


def edge_components(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the least id reachable.

    Rounds of least-neighbour label, then a label's label; each round's labels are a written table, and the number of
    rounds grows with the logarithm of the longest chain.
    """
    both = settled(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    labels = settled(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "y"), "y").groupBy(F.col("x").alias("id")).agg(F.min("component").alias("near"))
        step = settled(labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("component")), "labels")
        top = step.select(F.col("id").alias("__to"), F.col("component").alias("__top"))
        labels = settled(step.join(top, step["component"] == top["__to"]).select("id", "was", F.least("component", "__top").alias("component")), "labels")
        if not labels.filter("component <> was").limit(1).count():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b).  Vertices without edges are their own component."""
    found = edge_components(edges).select(F.col("id").alias("__id"), "component")
    return vertices.select("id").join(found, F.col("id") == F.col("__id"), "left").select("id", F.coalesce("component", "id").alias("component"))
