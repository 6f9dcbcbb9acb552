"""Connected components of an edge table by alternating stars, in Spark joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoy.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs, in any order and repeated -> (node, root): the smallest node of its component, for nodes with an edge.

    Each round hangs the larger neighbours of a node, then the smaller ones, on the smallest; the rounds grow with the
    logarithm of the longest path. A round is written out, so a lost executor costs one round.
    """
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = _state(links)
    while True:
        both = links.union(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        links = stored(small.select("e.u", "e.v").where("u > v").distinct(), "links")
        now = _state(links)
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _state(links: DataFrame) -> tuple:
    """Equal for equal link tables: the number of links and two sums over them."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)), F.coalesce(F.sum(h.bitwiseAND(F.lit((1 << 20) - 1))), F.lit(0))).first())
