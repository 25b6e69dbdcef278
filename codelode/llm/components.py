"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node reachable) for every node of edges (a long, b long).

    Each round replaces edges by as many that lie nearer to the least nodes, so tables never grow;
    rounds grow with the logarithm of the longest path. A step deals the edges once, by node and in the
    order of its neighbours: the first is the least, and equal edges follow one another, so a round has two
    exchanges and no join. A hub's narrow rows stream through one task, which spills them. Each round is cut off by
    checkpoint(); the last is the one that moves no edge.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    # of equal edges one that has moved comes first
    by = Window.partitionBy("u").orderBy("v", F.desc("moved"))
    first, last = F.first("v").over(by).alias("m"), F.lag("v").over(by).alias("last")
    no = F.lit(False).alias("moved")
    while True:
        # large star: neighbours above a node go to the least of its neighbourhood
        both = e.select(F.inline(F.array(F.struct("u", "v", no), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), no))))
        seen = both.select("u", "v", first, last).where("v > u and (last is null or last <> v)")
        large = seen.select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        # small star: a node and its neighbours below it go to the least of them
        seen = large.select("u", "v", "moved", first, last).where("last is null or last <> v")
        e = seen.select(F.when(F.col("last").isNull(), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"), (F.col("moved") | F.col("last").isNotNull()).alias("moved")).checkpoint()
        if e.where("moved").isEmpty():
            break
    # no edge moved: each node above its root has one edge
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())
