"""Connected components by alternating large and small stars, every round written to the shared folder.

Smallest neighbours are written before they are joined, so that a node with very many edges is split like any skewed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeworks.llm.scratch import drop, settled


def _stars(edges: DataFrame) -> DataFrame:
    """One round over edges (u > v): each neighbourhood hangs its members on its smallest node."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = settled(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    large = settled(large, "large")
    under = settled(large.groupBy("u").agg(F.min("v").alias("m")), "under")
    small = large.join(under, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    small = small.unionByName(under.select("u", F.col("m").alias("v"))).filter("u <> v")
    out = settled(small.distinct(), "small")
    drop(least, large, under)
    return out


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long ids to (id, component) for every id in an edge; component is the smallest id reachable."""
    a, b = F.col("a"), F.col("b")
    now = settled(edges.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    before, mark = None, _print(now)
    while mark != before and mark[0]:
        last, before = now, mark
        now = _stars(last)
        drop(last)
        mark = _print(now)
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = settled(found.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()), "components")
    drop(now)
    return out
