"""Connected components of a table of edges, by alternating large and small stars.

Every step is an aggregation (combined on the map side) and a join, written to the shared folder;
neither nodes nor edges ever come to the driver. The driver keeps a record of every task, so a round
has few shuffles, and no round is run only to see that nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hook the neighbours of each node to the least of them.

    large: neighbours above the node; small: neighbours below it, and the node itself.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    hooked = both.join(least, "a")
    out = hooked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b"))


def _settled(edges: DataFrame) -> bool:
    """Whether distinct ``edges`` are stars: each node has one edge up, or only edges down."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of ``edges`` (a, b) with the least node of its component."""
    now = stored(edges.filter(F.col("a") != F.col("b")).distinct())
    while True:
        now = stored(_star(_star(now, True), False).distinct())
        if _settled(now):
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
