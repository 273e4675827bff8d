"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a minimum per node (combined before the shuffle) and a join that Spark can split where a node is hot; the
edge table is spooled after each round, so a lost executor costs a stage. Nothing is gathered on the driver but a count
and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool


def least_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): the least of u's neighbours and u itself."""
    return spool(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a long, b long): component is the least node reachable.

    Nulls and loops are dropped and repeated edges count once; an empty table gives no rows.
    """
    now = spool(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_neighbour(both)
        large = spool(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least_below = least_neighbour(large)
        small = large.join(least_below, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = spool(small.unionByName(least_below.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for part in (now, least, large, least_below):
            unspool(part)
        now = after
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
