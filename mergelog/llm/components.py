"""Connected components by alternating large-star and small-star steps, all in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import salted_join
from .staging import Staging


def components(edges: DataFrame, staging: Staging, label: str = "cc") -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is the least node reachable.

    Each step rewires a node's neighbours to the least of them. Least neighbours are
    summed up map-side (min), and the join that gives them back to the edges salts nodes
    with many of them, so a star of any size is many tasks. Tables are written at each
    step, so lineage stays short. The loop ends when a step changes nothing, which a
    count and sums of hashes tell.
    """
    now = staging.table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{label}-0")
    mark, k = None, 0
    while True:
        # large star: greater neighbours of u go to the least of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = salted_join(both, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staging.table(large, f"{label}-large-{k}")
        # small star: lesser neighbours of u, and u, go to the least of them
        met = salted_join(large, large.groupBy("u").agg(F.min("v").alias("m")), ["u"])
        small = met.select(F.explode(F.array(F.struct(F.col("u").alias("x")), F.struct(F.col("v").alias("x")))).alias("e"), "m").select(F.col("e.x").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        then = staging.table(small, f"{label}-{k + 1}")
        total = then.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum((F.xxhash64("u", "v") % 1000003).cast("long"))).first()
        staging.drop(f"{label}-{k}", f"{label}-large-{k}")
        now, k = then, k + 1
        if tuple(total) == mark:
            break
        mark = tuple(total)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
