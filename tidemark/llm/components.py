"""Connected components by alternating large-star and small-star steps.

Each step is one aggregation and one join on edges, never a group in one task's memory; the edge
list is written to the shared folder between steps, and observed while it is: it is done when a step
leaves it as it was. A hub with a large share of all edges is pre-aggregated before the shuffle, and
the join on it is left to the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.llm.staging import discard, staged


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) with v any neighbour of u, either way round, and m the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` has bigint columns ``a`` and ``b`` without nulls; loops and repeats are allowed.
    Gives ``node, component`` for each node of an edge; the component is its least node."""
    current, held = _written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large.where("u <> v"))
        # each lower neighbour and u itself point to the least one
        small = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        following, left = _written(small)
        discard(current)
        current = following
        if left == held:
            roots = current.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        held = left


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct edges, staged, and what tells two sets of them apart: count and two sums of hashes."""
    seen = Observation()
    sums = [F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "u", "v")), F.lit(0)).alias(f"h{seed}") for seed in (1, 2)]
    out = staged(edges.observe(seen, F.count(F.lit(1)).alias("n"), *sums), "edges", narrow=True)
    return out, tuple(sorted(seen.get.items()))
