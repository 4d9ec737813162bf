"""Connected components by distributed large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.llm.common import materialize


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest number that it can reach.

    Stars are rewired in turn towards the larger and the smaller neighbours until nothing changes;
    the steps grow with the logarithm of the graph. Each is written to the shared folder. A star of
    any size is only summed by its centre and joined by it, never gathered in a group.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("n"), F.least("a", "low").alias("low"))
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        large = materialize(large.where("a <> b"), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "n")
        joined = large.join(least, large["a"] == least["n"])
        moved = joined.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = least.select(F.col("n").alias("a"), F.col("low").alias("b")).union(moved).distinct()
        now = materialize(small, "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
