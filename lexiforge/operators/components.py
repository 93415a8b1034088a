"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lexiforge.store import materialize


def _written(edges: DataFrame, name: str) -> tuple[DataFrame, tuple[int, int]]:
    """The edges as a written table, with their number and a mark of them all, taken while they are written."""
    seen = Observation()
    marks = (F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("mark"))
    table = materialize(edges.observe(seen, *marks), name)
    return table, (seen.get["n"], seen.get["mark"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Each round groups by node with a map-side minimum and joins it back to the edges, so a hub with many edges is never
    gathered: its minimum is one row, and the join that reads its edges may be split by adaptive execution because both
    sides of it are written tables. Rounds grow with the logarithm of the longest path. Self loops only state a node.
    Edges with a null end are ignored. An empty list gives an empty result.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    loops = e.where("u = v").select("u").distinct()
    e, seen = _written(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while seen[0]:
        # large star: hang every larger neighbour of a node on the smallest member of its neighbourhood
        low = materialize(
            e.select("u", F.col("v").alias("w")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("w"))).groupBy("u").agg(F.min("w").alias("m")),
            "low",
        )
        low = low.select("u", F.least("u", "m").alias("m"))
        large = (
            e.select(F.col("v").alias("u"), F.col("u").alias("w"))  # neighbours above the node
            .join(low, "u")
            .select(F.col("w").alias("u"), F.col("m").alias("v"))
            .where("u != v")
            .distinct()
        )
        large = materialize(large, "large")
        # small star: hang a node and its smaller neighbours on the smallest of them
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, now = _written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if now == seen:
            break
        seen = now
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = found.unionByName(roots)
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component")).join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone)
