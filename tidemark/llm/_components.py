"""Connected components over an edge table, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import keep


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(id, component) of every end of edges (a, b); component is the smallest id reachable.

    Edges come from forests, several of which may hold the same nodes: first every node keeps its edge to the smallest
    of its smaller neighbours alone, to which the others of them are tied instead. A node's smaller neighbours are the
    roots of the forests it is in. Each round takes the smallest label among neighbours, then the label of that label,
    so the distance covered doubles. Rounds stop when no label changes. Only sums reach the driver.
    """
    roots = edges.filter("a <> b").groupBy(F.greatest("a", "b").alias("a")).agg(F.collect_set(F.least("a", "b")).alias("roots"), F.min(F.least("a", "b")).alias("b"))
    edges = roots.select(F.explode(F.concat(F.array("a"), "roots")).alias("a"), "b").distinct()
    both = keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(most):
        seen = labels.withColumnRenamed("id", "b").withColumnRenamed("component", "seen")
        near = both.join(seen, "b").groupBy(F.col("a").alias("id")).agg(F.min("seen").alias("seen"))
        step = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "seen").alias("via"))
        up = labels.select(F.col("id").alias("via"), F.col("component").alias("up"))
        moved = keep(step.join(up, "via").select("id", "was", F.least("via", "up").alias("component")))
        changed = moved.agg(F.sum((F.col("was") != F.col("component")).cast("long"))).first()[0]
        labels = moved.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {most} rounds")
