"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _starred(edges: DataFrame, hub: str, leaf: str) -> DataFrame:
    least = edges.groupBy(F.col(hub).alias("_hub")).agg(F.min(leaf).alias("_least"))
    return edges.join(least, F.col(hub) == F.col("_hub"))


def _round(edges: DataFrame) -> DataFrame:
    """One large and one small star; ``edges`` are (hi, lo) with hi > lo."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
    large = (
        _starred(both, "u", "v")
        .filter("v > u")
        .select(F.col("v").alias("hi"), F.least("u", "_least").alias("lo"))
        .filter("hi > lo")
        .distinct()
    )
    spread = _starred(large, "hi", "lo")
    return (
        spread.select(F.explode(F.array(F.struct("hi", F.col("_least").alias("lo")),
                                        F.struct(F.col("lo").alias("hi"), F.col("_least").alias("lo")))).alias("e"))
        .select("e.hi", "e.lo")
        .filter("hi > lo")
        .distinct()
    )


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has a link; ``root`` is the least node it reaches.

    Links are folded into stars round after round, each a combined minimum and an equi join; the
    number of rounds grows with the logarithm of the longest path. Every round is stored in the
    shared folder, and only a count and a checksum reach the driver.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = stored(links.select(high.alias("hi"), low.alias("lo")).filter("hi > lo").distinct(), "links")
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(hi, lo))")).first()
        if state == before or not state[0]:
            break
        before = state
        edges = stored(_round(edges), "links")
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(edges.select(F.col("lo"), F.col("lo")).distinct())
