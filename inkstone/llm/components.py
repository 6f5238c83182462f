"""Connected components: of tables by alternating large-star and small-star rounds, and of a task's links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node reachable) for every node of an edge.

    ``edges`` has two long columns ``a`` and ``b``; direction, repeats and
    loops don't matter, rows with a null are no edges. A hub's edges are never
    brought together: minima are combined before the shuffle and joined back,
    so the engine may split a hub's partition. Stops when every edge leads from a
    component's node to its smallest; each round is written to the shared folder.
    """
    e = scratch.keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(most_rounds):
        if _all_stars(e):
            break
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.keep(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
        scratch.drop(e)
        e = after
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    roots = e.select("b").distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component"))
    )


def _all_stars(e: DataFrame) -> bool:
    """Whether each node has one edge towards a smaller one, which has none itself."""
    ends = e.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        e.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable over the links (a, b), for each of 0 to n - 1."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == was).all():
            return low
