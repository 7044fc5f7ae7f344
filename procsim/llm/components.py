"""Connected components of a graph that no single task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from procsim.storage import staged



def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``a, b`` (longs) in; ``node, root`` out for each node of a link, root being the smallest node of its component.

    Alternating large-star and small-star contraction: each node's larger, then smaller, neighbours are
    linked to its smallest neighbour, until nothing changes. Each step is a minimum per node (combined before the shuffle) and a
    join back, which Spark can split at a hot node. Rounds grow with the logarithm of the longest path.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, seen = staged(edges, f"{name}-0"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("v", "u"))
        # minima are written, so that each join is one of two plain exchanges
        least = staged(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, f"{name}-large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = staged(small.filter("u <> v").distinct(), f"{name}-small")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
