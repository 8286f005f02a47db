"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import stored


def connected_components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``node, component`` of every node with a link, from ``a, b``; a component is named by its smallest node.

    ``known`` has the components of earlier links: these links then join what is
    joined there, and only they are followed.

    Each node points to the smallest node that is at most two links away, pointers
    are followed to their roots by doubling, and links between roots remain for the
    next round; a star takes one. All of it is joins and minima, so a node with any number of links is
    no bottleneck. Each step is a stored table.
    """
    if known is not None:
        a, b = (known.select(F.col("node").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
        links = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    links = stored(links.where(F.col("a") != F.col("b")).select("a", "b"))
    if known is not None and links.isEmpty():
        return known
    labels = None
    while labels is None or not links.isEmpty():
        both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))).select("col.a", "col.b")
        near = both.groupBy(F.col("a").alias("b")).agg(F.least(F.min("b"), F.col("a")).alias("least"))
        roots = stored(both.join(near, "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("root")))
        while True:
            # Where a pointer leads to a node that is no root itself, take that node's pointer.
            far = roots.select(F.col("node").alias("root"), F.col("root").alias("next")).where(F.col("root") != F.col("next"))
            moved = stored(roots.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            roots = moved.select("node", "root")
            if moved.where("moved").isEmpty():
                break
        if labels is None:
            labels = roots.withColumnRenamed("root", "component")
        else:
            step = roots.select(F.col("node").alias("component"), "root")
            labels = stored(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        ends = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        links = stored(ends.where(F.col("ra") != F.col("rb")).select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if known is None:
        return labels
    renamed = known.join(labels.select(F.col("node").alias("component"), F.col("component").alias("new")), "component", "left")
    fresh = labels.join(known.select("node"), "node", "left_anti")
    return stored(renamed.select("node", F.coalesce("new", "component").alias("component")).unionByName(fresh))
