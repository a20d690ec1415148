"""Connected components of an edge list by star contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelattice.llm.store import discard, join_groups, materialise


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b); label is the smallest node reachable.

    Alternates large-star and small-star steps, in which every node's
    neighbours are hung on its smallest one. The rounds grow with the logarithm
    of the longest path; each round is written to the shared folder. Groups are
    only ever aggregated to their minimum, and a hub's edges are not moved to
    join that, so a hot node costs neither memory nor a slow task.
    """
    edges = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "cc")
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        low = low.select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both, low, ["u"], "n", 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u != v").distinct(), "cc-large")
        down = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_groups(large, down, ["u"], "n", before[0])
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", F.col("m").alias("v")))
        after = materialise(small.where("u != v").distinct(), "cc")
        discard(edges, large)
        state, edges = _state(after), after
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return nodes.union(roots)


def _state(edges: DataFrame) -> tuple:
    """Size and checksum of an edge set, to see when a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
