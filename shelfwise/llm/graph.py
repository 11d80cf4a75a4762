"""Connected components by alternating star contraction.

Each round is a few shuffles over the links; what is left of the links is written to the
shared folder after it. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import settled


def _star(pairs: DataFrame) -> DataFrame:
    """(node, least): per node the least of itself and its neighbours in ``pairs``."""
    return pairs.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))


def _large(edges: DataFrame) -> DataFrame:
    """Hangs every larger neighbour of a node on the least one."""
    both = edges.select(F.col("src").alias("node"), F.col("dst").alias("other")).unionByName(
        edges.select(F.col("dst").alias("node"), F.col("src").alias("other"))
    )
    joined = both.join(_star(both), "node").where("other > node")
    return joined.select(F.col("other").alias("src"), F.col("least").alias("dst")).where("src > dst")


def _small(edges: DataFrame) -> DataFrame:
    """Hangs a node and its smaller neighbours on the least of these."""
    down = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"))
    least = _star(down)
    moved = down.join(least, "node").select(F.col("other").alias("src"), F.col("least").alias("dst"))
    own = least.select(F.col("node").alias("src"), F.col("least").alias("dst"))
    return moved.unionByName(own).where("src > dst")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link; root is the least node reachable.

    ``edges`` has src and dst of one orderable type, in any direction, repeats allowed.
    """
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    edges = settled(edges.where("src > dst").distinct())
    before = None
    while True:
        state = edges.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(20,0)"))
        ).first()
        if state == before or not state[0]:
            break
        before = state
        edges = settled(_small(_large(edges)).distinct())
    tops = edges.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).unionByName(tops)
