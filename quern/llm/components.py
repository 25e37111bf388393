"""Connected components of an undirected graph whose edges are a table.

Alternating large-star and small-star steps: each links a node's neighbours to the least node among them, so the number of rounds grows with the logarithm of the paths' lengths. Minima are aggregated before they meet the edges: by broadcast where the edges, and so the nodes, are counted to be few, else written first, so that both sides of the join are plain shuffles and adaptive execution can split a hub's rows. Each round is written to the shared folder; nothing but a count and a checksum comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Edges up to which a row for each node is broadcast.
BROADCAST_EDGES = 500_000


def components(edges: DataFrame, scratch: Scratch, tag: str, max_rounds: int = 40) -> DataFrame:
    """edges (a, b) of any type that has an order, in any direction, with repeats or loops -> (id, component), component being the least id; only nodes that have an edge to another."""
    now = scratch.save(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{tag}-edges")
    seen, n = None, now.count()

    def met(df: DataFrame, name: str) -> DataFrame:
        """One row for each node, ready to meet the edges: broadcast while there are few edges, else written."""
        return F.broadcast(df) if n <= BROADCAST_EDGES else scratch.save(df, name)

    for k in range(max_rounds):
        # large star: every greater neighbour of u goes to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = met(least, f"{tag}-least{k}")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        # small star: u and its lesser neighbours go to the least of them; few edges are found again, which takes no shuffle
        if n > BROADCAST_EDGES:
            large = scratch.save(large.distinct(), f"{tag}-large{k}")
        low = met(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-low{k}")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{tag}-round{k}")
        scratch.free(*([f"{tag}-edges"] if not k else [f"{tag}-round{k - 1}"]), f"{tag}-large{k}", f"{tag}-least{k}", f"{tag}-low{k}")
        now = scratch.spark.read.parquet(scratch.path(f"{tag}-round{k}"))
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen, n = sign, sign[0]
    raise RuntimeError("components have not settled")
