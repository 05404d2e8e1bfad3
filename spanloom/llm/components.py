"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, scratch

#: Edges in a file of the rounds' tables, about.
FILE_EDGES = 500_000


@scratch
def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: each node of edges (a, b) with the least node of its component.

    Every round links, for each node, its larger neighbours and then its smaller ones to the least node it knows. Both halves are a
    grouped minimum, which combines before the shuffle, and an equi-join, which Spark can split where a node is hot. Self loops,
    repeated and reversed edges are harmless; without edges the result is empty.
    """
    now = materialise(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, files = None, now.count() // FILE_EDGES + 1
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, files)
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        now = materialise(large.join(small, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where(F.col("u") != F.col("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct(), files)
        after = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
