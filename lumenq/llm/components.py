"""Connected components of an edge table, by alternating large-star and small-star steps.

The smallest neighbours are written before they are joined: both sides of the join then have an exchange of
their own, and adaptive execution can split the rows of a hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import drop_shared, shared_table


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    least = shared_table(least, "components-least")
    out = both.join(least, F.col("u") == F.col("w")).where("v > u")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    least = shared_table(least, "components-least")
    out = edges.join(least, F.col("u") == F.col("w"))
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of ``edges`` (u, v of one ordered type) but the smallest of its component,
    with that smallest. Rounds grow with the logarithm of the nodes; each is a written table, and only
    its checksum comes to the driver."""
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = shared_table(edges, "components")
    total = None
    while True:
        then = shared_table(_small_star(_large_star(now)), "components")
        found = then.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_shared(now)
        if found == total:
            return then
        now, total = then, found
