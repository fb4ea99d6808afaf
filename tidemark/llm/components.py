"""Connected components of a link table, as rounds of joins and minima over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """Columns ``node`` and ``root``, the smallest node that it reaches, for every node of ``links`` (``a``, ``b``).

    Every round hangs the larger neighbours of each node, then the smaller ones, onto the smallest node known
    nearby, which leaves components unchanged and ends in one star per component after a number of rounds that grows
    with the logarithm of the nodes.  A node's neighbours are never gathered: rounds are minima and joins, and both
    sides of each join are stored tables, so that adaptive execution can split the links of a star's centre.
    Links to itself and repeated links have no effect; links with a null end are ignored.
    """
    edges = cut_lineage(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = cut_lineage(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.distinct())
        down = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(down, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct())
