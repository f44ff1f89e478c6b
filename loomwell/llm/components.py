"""Connected components by alternating large-star and small-star steps, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The least neighbours of a round are broadcast while there are this many edges or fewer (counted each
#: round), so the edges of a hub do not meet in one task; beyond, AQE splits the hub's partition.
BROADCAST_EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _tidy(edges: DataFrame) -> DataFrame:
    return (
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (node, root), root the smallest node reachable.

    Nodes without an edge are absent.  Each round is a fixed number of shuffles over the
    edges; the result is reached when a round changes nothing.  Empty input gives an empty result.
    """
    cur = cut(_tidy(edges))
    was = _state(cur)
    while was[0]:
        side = F.broadcast if was[0] <= BROADCAST_EDGES else lambda df: df
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(cur.select("lo", "hi"))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(side(low), "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        star = _tidy(large)
        low = star.groupBy("hi").agg(F.min("lo").alias("m"))
        small = star.join(side(low), "hi").select(F.col("lo").alias("a"), F.col("m").alias("b")).union(low.select("hi", "m"))
        cur = cut(_tidy(small))
        now = _state(cur)
        if now == was:
            break
        was = now
    return cur.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")).union(
        cur.select(F.col("lo").alias("node"), F.col("lo").alias("root")).join(cur.select(F.col("hi").alias("node")), "node", "left_anti").distinct()
    )
