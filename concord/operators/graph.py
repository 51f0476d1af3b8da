"""Connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.tables import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for undirected ``(src, dst)`` edges: the smallest node each is connected with.

    Alternates large-star and small-star steps until no edge changes; rounds
    grow with the logarithm of the longest chain, and it is an error if
    ``max_rounds`` are not enough.  Every step is an aggregate with map-side
    combine plus an equi-join of tables just read from storage, so Spark can
    split the join of a hub.  A round's edges are written to the shared folder;
    nothing reaches the driver but two numbers.  Nodes without edges do not
    appear; an empty table gives an empty table.  The result is a written table.
    """
    current = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    seen = None
    for turn in range(max_rounds + 1):
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        if turn == max_rounds:
            raise RuntimeError(f"components have not settled after {max_rounds} rounds")
        seen = state
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(lowest, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = large.join(least, F.col("u") == F.col("k"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("k", "m"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        after = materialise(small, "edges")
        discard(large)
        discard(current)
        current = after
    labels = current.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    labels = materialise(labels.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "labels")
    discard(current)
    return labels
