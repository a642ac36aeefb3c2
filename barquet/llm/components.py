"""Connected components of a graph of links, as DataFrame operations only.

Distributed union-find by alternating stars: every round hangs each node's larger neighbours, then
its smaller ones, below the smallest neighbour, so that trees flatten in a logarithmic number of
rounds. Rounds are written to the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v), u > v. Each node's larger (else: smaller) neighbours move to its smallest neighbour."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(least, "u")
    if larger:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links`` (columns u, v): root is the smallest node it is connected to.

    Nulls and loops are ignored; repeated links count once; an empty table gives an empty table.
    """
    links = links.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    links = common.cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
        links = common.cut(_star(_star(links, True), False))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
