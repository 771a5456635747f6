"""Connected components of an edge table, by alternating star operations.

Links stay distributed: each round writes the edges to the shared folder and
only their number and a checksum reach the driver.  A round replaces every
neighbour's edge by one to the smallest node around, first for larger, then for
smaller neighbours; the number of rounds grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """edges: (src > dst).  Larger: neighbours above a node go to its minimum; else those below, and itself."""
    if larger:
        sides = edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = sides.where("v > u").join(least, "u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
        return moved.distinct()
    least = edges.groupBy("src").agg(F.min("dst").alias("m"))
    below = edges.join(least, "src")
    moved = below.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return moved.unionByName(least.select("src", F.col("m").alias("dst"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that it reaches.

    ``edges``: (src, dst) of longs in any direction, repeats and loops allowed.
    No edges give no rows.
    """
    edges = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = _state(edges)
    while True:
        edges = cut(_star(_star(edges, larger=True), larger=False))
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
