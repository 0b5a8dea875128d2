"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from holdfast.llm.common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list of longs; the component
    is its smallest node.

    Large-star and small-star steps alternate until nothing changes. Each step
    is a minimum per node (pre-aggregated on the map side) and a join with it;
    the minima are written first, so both join sides are plain exchanges that
    adaptive execution can split when one node has a large share of the edges.
    Every round is written to the checkpoint folder: lineage stays short and a
    lost executor repeats one round at most.
    """
    u, v = F.greatest(a, b), F.least(a, b)
    current = written(edges.select(u.alias("u"), v.alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), "large-star")
        up = both.where("v > u").join(low, F.col("u") == F.col("node")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = written(up.where("u <> v").distinct(), "large-star-edges")
        low = written(star.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m"), "small-star")
        down = star.join(low, F.col("u") == F.col("node")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = written(down.union(low.select("node", "m")).distinct(), "small-star-edges")
        found = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
