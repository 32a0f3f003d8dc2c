"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_join, staged


def connected(links: DataFrame) -> DataFrame:
    """(node, label) for each node of links(a, b), of any type that has an order: the least node that links reach.

    Alternates large-star and small-star rounds (Kiveris et al. 2014), each a pair of aggregations and joins over the
    links, until the links no longer change: then each points from a node to the least one of its component. A node
    of very many links is dealt over several tasks in both joins. Links from a node to itself do not count; without
    links there are no nodes.
    """
    edges = staged(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("count"))
        hot = hot_keys(near.select("u", "count"))
        large = salted_join(both.filter("v > u"), near.drop("count"), "u", "v", hot=hot).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large) if hot is not None else large  # three plans below read it
        # large points from each node to lesser ones: no more than its links above, so hot nodes are among the same
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, "u", "v", hot=hot).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct() if before else nodes
