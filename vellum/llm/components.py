"""Connected components of an edge table by alternating large-star and small-star rounds.

All state is in tables: each round writes its edges to the shared folder and the driver sees
only their count and checksum. Hot nodes are aggregated before their shuffle, and joins back
to them are plain shuffled joins whose large partitions can be split.

Cases: loops and repeated edges do no harm, null ends are dropped, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.plans.runtime import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of edges (u, v); the label is the component's smallest node."""
    ordered = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.save(ordered, "edges")
    seen = _checksum(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # Large star: every larger neighbour of u is linked to the least of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        middle = scratch.save(large, "large")
        # Small star: u and its smaller neighbours are linked to the least of these.
        least = middle.groupBy("u").agg(F.min("v").alias("m"))
        joined = middle.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = scratch.save(small.where("u != v").distinct(), "edges")
        scratch.drop(now, middle)
        now, before = after, seen
        seen = _checksum(now)
        if seen == before:
            break
    else:
        raise RuntimeError("components have not settled")
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    """Count and order-free sums of hashes, in halves so that they cannot overflow."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h % 1000000007), F.sum(F.shiftright(h, 32))).first())
