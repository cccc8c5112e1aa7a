"""Connected components of a table of links, by alternating stars.

Each round ties the neighbours of every node to the least of them, first those above it,
then those below; the links are grouped and joined as tables, so nothing is gathered
whole, and a hub's links are split by Spark as skewed join keys. The number of rounds
grows with the logarithm of the longest path. Each round is cut from its lineage by a
checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROUNDS = 60


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) for every node that has a link.

    Links of a node with itself and repeated links change nothing; links with a null end
    are left out. No links give an empty table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    # every link points from a node (u) to a lower one (v)
    stars = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(high.alias("u"), low.alias("v")).distinct().checkpoint()
    state = lambda: stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = state()
    for _ in range(MOST_ROUNDS):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u"))).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.unionByName(below.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct().checkpoint()
        now = state()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links are not settled after {MOST_ROUNDS} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
