"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node, with partial minima first; each round is
written to the shared folder, so plans stay short and a lost executor costs a reread. The number of
rounds grows with the logarithm of the longest path. Nothing is collected but whether a round was the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tensorloom.llm.scratch import freed


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges(a, b)`` but the roots themselves.

    The root is the component's least node. Self-links and repeated links do no harm; without
    links the result is empty.
    """
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = freed(links, "links")
    for _ in range(most_rounds):
        if _stars(links):
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = freed(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
    raise RuntimeError(f"no fixed point after {most_rounds} rounds")


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link, and that to a node without any: then all is settled."""
    forked = links.groupBy("u").count().where(F.col("count") > 1).select("u")
    chained = links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
    return forked.unionByName(chained).isEmpty()
