"""Breadth-first reach over links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node and depth of all nodes that links (src, dst) lead to from the seeds (node), seeds included.

    Each round follows the frontier's links and drops what was visited by an anti join; rounds end with an empty
    frontier. Levels are checkpointed, so a lost executor costs one round. Null nodes are left out.
    """
    edges = cut(edges.select("src", "dst").filter("src is not null and dst is not null").distinct())
    frontier = visited = cut(seeds.select("node").filter("node is not null").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while not frontier.isEmpty():
        depth += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = cut(found.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        visited = visited.unionByName(frontier)
    return visited
