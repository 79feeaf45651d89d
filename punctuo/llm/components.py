"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from punctuo.llm.common import cut, forget


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang every node's larger (large star) or smaller (small star) neighbours on its smallest neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: longs) to (node, component): the smallest node reachable; only nodes with edges are listed.

    Ends when a round changes nothing; rounds grow with the logarithm of the nodes.  Each round is written to the shared
    folder, as lineage would grow otherwise.  Hot nodes are no single group: minima are taken before the shuffle.
    """
    edges = cut(edges.select("a", "b").filter("a <> b").distinct(), "components")
    sign = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")))
    seen = None
    while not edges.isEmpty():
        before, edges = edges, cut(_star(_star(edges, True), False), "components")
        forget(before)
        now = edges.agg(sign).first()[0]
        if now == seen:
            break
        seen = now
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
