"""Connected components of an undirected graph by alternating stars (Kiveris et al., 2014), in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node and root (the least node of its component) of every node that has an edge; edges: columns a, b.

    Loops and repeated edges do no harm. Edges are written to the shared folder after each round, with their number and checksum told
    on the way, and the last round's deleted; the rounds end when nothing changes, which takes about the logarithm of the longest path.
    """
    now, said = _written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    for _ in range(rounds):
        if not said[0]:
            break
        # Large stars: the greater neighbours of each node go to its least one, or itself.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        # Small stars: the lesser neighbours of each node, and itself, go to the least of them.
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        last, before = now, said
        now, said = _written(small.select(F.inline(pairs)).filter("u != v").distinct())
        common.forget(last)
        if said == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    told = Observation()
    out = common.written(edges.observe(told, F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("sum")))
    return out, (told.get["n"], told.get["sum"])
