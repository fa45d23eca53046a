"""Connected components of a graph of links, in rounds that each write their links.

Each round points every node's larger neighbours at its smallest neighbour, and then
its smaller neighbours too (the large-star and small-star steps), until each component
is a star around its smallest node. Links are pre-aggregated before every shuffle; the
join on a hub's node can be split, because only its small side is aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import Cuts

#: A star step halves long chains at least; this many rounds cover any corpus.
MOST_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    """(u, v) with u > v: each node's larger neighbours point at the smallest of the node and its neighbours."""
    flipped = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = links.unionByName(flipped).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return flipped.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours point at the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array("u", "v")).alias("u")
    return links.join(least.hint("merge"), "u").select(ends, F.col("m").alias("v")).where("u > v").distinct()


def _settled(links: DataFrame) -> bool:
    """True if the links are stars: each node points at one root, and no root points anywhere."""
    nodes = links.groupBy("u").agg(F.count("*").alias("n"))
    return nodes.where("n > 1").isEmpty() and links.select("v").distinct().join(nodes.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi").isEmpty()


def components(links: DataFrame, cuts: Cuts) -> DataFrame:
    """(u, v) links of long ids, any direction -> (node, root), root the smallest node reachable.

    Nodes without links are not in the result. Null ends and loops are ignored.
    """
    now = cuts.write(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(MOST_ROUNDS):
        if _settled(now):
            break
        for step in (_large, _small):
            after = cuts.write(step(now))
            cuts.drop(now)
            now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
