"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, spread_join, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge, roots included; root is the component's least node.

    Each round joins the edges with their nodes' least neighbours and writes the outcome to the shared folder;
    no neighbour list is ever gathered, a hub's edges are spread over tasks, and the number of rounds grows with
    the logarithm of the longest path."""
    spark = edges.sparkSession
    now = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    state, ends = None, 2 * now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = spread_join(both, least, ["u"], "n", ends).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(down, least, ["u"], "n", ends).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v")
        after = written(small.distinct(), "edges")
        new = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, now)
        now = after
        if new == state or not new[0]:
            break
        state, ends = new, 2 * new[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
