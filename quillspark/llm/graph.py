"""Connected components of a link table, with the links never leaving the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import scratch


def _star(edges: DataFrame) -> DataFrame:
    """Each node with the least of itself and its neighbours, joined back to its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (the smallest node reachable) for every node of ``links``.

    Large-star and small-star steps in turn: all neighbours above a node are hung on its
    least neighbour, then all below. Depth halves or better in a round; each round is
    written to the shared scratch folder. Minima are pre-aggregated before the shuffle, and a
    node with many links is a skewed join that the adaptive planner splits. Links with a
    null end are ignored; an empty table gives an empty result.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    nodes = ends.select("u").union(ends.select("v")).distinct()
    edges = scratch(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large.filter("u > v").distinct())
        hung = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        edges = scratch(hung.filter("u <> v").distinct(), "links")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return nodes.join(edges, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
