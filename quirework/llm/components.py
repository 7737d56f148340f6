"""Connected components of an edge table by alternating stars.

Each round points every node's larger neighbours at its least neighbour
(large star), then every node and its smaller neighbours at their least
(small star), until nothing changes: a number of rounds that grows with the
logarithm of the longest chain. The least neighbour is found by partial
aggregation, and a hub's rows are joined with the one row that holds it where
they are: hubs with more than a thousandth of all rows are few and broadcast.
Each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirework.llm.common import drop_path, fresh_path, join_unique


def components(edges: DataFrame, kind: str = "bigint", least_hot: int = 10_000) -> DataFrame:
    """(node, root) for each node of edges (u, v) except for the roots; root is the least node that can be reached.

    Loops, repeats and either direction of an edge are fine; rows with a null
    are no edges. kind is the type of a node.
    """
    spark = edges.sparkSession
    good = edges.where("u <> v").select(F.greatest("u", "v").cast(kind).alias("node"), F.least("u", "v").cast(kind).alias("root")).distinct()
    path, before = fresh_path(spark, "star"), None
    good.write.parquet(path)
    while True:
        now = spark.read.schema(f"node {kind}, root {kind}").parquet(path)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root")), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now
        both = now.select(F.col("node").alias("a"), F.col("root").alias("b")).union(now.select(F.col("root").alias("a"), F.col("node").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n")).select("a", F.least("a", "low").alias("low"), "n")
        large = join_unique(both, least, "a", "n", 2 * state[0], least=least_hot).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"), F.count("*").alias("n"))
        small = join_unique(large, least, "a", "n", state[0], least=least_hot).where("b <> low").select(F.col("b").alias("node"), F.col("low").alias("root"))
        after = fresh_path(spark, "star")
        small.union(least.select(F.col("a").alias("node"), F.col("low").alias("root"))).distinct().write.parquet(after)
        drop_path(spark, path)
        path, before = after, state
