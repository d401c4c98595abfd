"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of comparable ids -> (node, component): the smallest id reachable.

    Only nodes with an edge to another node appear; null ends and loops are ignored. Every round
    is two joins on stored tables, so Spark can split the partition of a hub with many edges, and
    the number of rounds grows with the logarithm of the longest path.
    """
    now = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.least("u", F.min("v")).alias("low")), "least")
        large = stored(
            both.join(least, "u").filter("v > u and v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(),
            "large-star",
        )
        least = stored(large.groupBy("u").agg(F.min("v").alias("low")), "least")
        small = large.join(least, "u").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = stored(small.unionByName(least.withColumnRenamed("low", "v")).distinct(), "small-star")
        before, state = state, _state(now)
        if before == state:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free checksum."""
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
