"""Connected components of an edge table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

#: Rounds grow with the logarithm of the longest path; so many mean that something else is wrong.
MAX_ROUNDS = 200


def components(edges: DataFrame, name: str = "components", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the smallest node reachable.

    Each round links larger neighbours to a node's smallest one (large star), then smaller
    ones to the smallest (small star); the edges end as one star a component. All state is in
    stored tables; only counts reach the driver. Rounds go on until nothing changes; if
    ``max_rounds`` do not suffice, that is an error and no result.
    """
    state = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    seen = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # stored, so that the join reads two plain exchanges and Spark can split the rows of a star's centre
        low = stored(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{name}-low")
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # a node has few smaller neighbours by now
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        down = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        state = stored(down.distinct(), name)
        mark = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = mark
    raise RuntimeError(f"components of {name} did not settle in {max_rounds} rounds")
