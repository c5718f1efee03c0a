"""Connected components of a distributed edge list, by alternating star contractions.

Every round hangs the larger neighbours of a node on its smallest neighbour (large
star), then the smaller ones (small star). Rounds are joins and minimum aggregates over
the edges, so no node's neighbourhood is ever gathered in one task, and each round's
edges are written to the shared folder. The number of rounds grows with the logarithm
of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm.tables import dropped, saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of comparable nodes to (node, root), root the smallest node reachable.

    Nodes without an edge are their own component and do not appear; loops and null ends
    are ignored, repeated edges do no harm.
    """
    now = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        dropped(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
