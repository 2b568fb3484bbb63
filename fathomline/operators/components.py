"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.operators.resolve import resolve_remap
from fathomline.sources.landing import dropped, kept


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for each node on a link to another, ``root`` its component's smallest node.

    In a round each node that has a smaller neighbour points to the smallest; pointers are followed to their ends by
    doubling, and links are led to these ends. What is left is at most half the nodes, so rounds are few. Only minima are
    aggregated, never lists of neighbours.
    """
    now = kept(links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct(), "links")
    found = kept(now.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while not now.isEmpty():
        ends = resolve_remap(now.groupBy(F.col("b").alias("loser")).agg(F.min("a").alias("survivor")))
        lead = lambda df, c, ends=ends: df.join(ends.select(F.col("loser").alias(c), F.col("survivor").alias("_end")), c, "left").withColumn(c, F.coalesce("_end", c)).drop("_end")
        led = lead(lead(now, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new, named = kept(led, "links"), kept(lead(found, "root").select("node", "root"), "roots")
        for done in (now, ends, found):
            dropped(done)
        now, found = new, named
    return found
