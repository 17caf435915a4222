"""Connected components of links by alternating stars.

Large-star links every larger neighbour of a node to the node's least neighbour, small-star every
smaller one (Kiveris et al., "Connected Components in MapReduce and Beyond").  Nothing is collected;
each round's links are written to the shared folder.  A node's least neighbour comes from an
aggregate that combines before the shuffle, and is written too, so that both sides of the join
back are plain shuffles, whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wireloom.llm.shared import kept


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b); root is the component's least node. Self-links and nulls are ignored."""
    links = kept(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = links.union(links.select("b", "a"))
        least = kept(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        links = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        links = kept(links)
        least = kept(links.groupBy("a").agg(F.min("b").alias("m")))
        joined = links.join(least, "a")
        # one of the two halves comes from the aggregate alone: (a, m) for each a
        links = kept(joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
