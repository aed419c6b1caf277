"""Connected components of a link table, in the cluster: alternating large-star and small-star.

Links never reach the driver; each round writes its links to the shared folder. Rounds grow with
the logarithm of the longest path. The only group a round gathers is a minimum, aggregated before
it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's greater neighbours, linked with the least of the node and its neighbours."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    star = both.join(least, "u").filter("v > u AND v <> m")
    return star.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node (a) and its smaller neighbours (b), linked with the least of these."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    star = links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return star.union(least.select("a", "m")).distinct()


def components(links: DataFrame, label: str = "links") -> DataFrame:
    """(node, root): every node that has a link, and the least node it can reach.

    ``links``: (a, b), longs, in any direction and order, repeated or looping links allowed. No
    links give no rows.
    """
    now = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, small=True)
    before = None
    while True:
        after = written(_small_star(_large_star(now)), label, small=True)
        state = tuple(after.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        discard(now)
        now = after
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
