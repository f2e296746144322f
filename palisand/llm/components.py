"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisand.llm.shared import LOOKUP, looked_up, released, staged


def _with_least(links: DataFrame, least: DataFrame, few: bool) -> DataFrame:
    """links (a, b) and m of their a; the links of one node, however many, are dealt out."""
    return links.join(F.broadcast(least), "a") if few else looked_up(links, staged(least, "least"), "a", "inner", F.col("b"))


def _large_star(links: DataFrame, few: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return _with_least(both.filter("b > a"), least, few).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame, few: bool) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = _with_least(down, least, few)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node of links (a, b, both long) that is not the least itself.
    Rounds of large and small stars until nothing changes; while there are few links, least neighbours are broadcast."""
    links = staged(links.filter("a <> b").distinct(), "links")
    seen = None
    while True:
        state = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen, few = state, 2 * state[0] <= LOOKUP
        large = _large_star(links, few)
        larger = large if few else staged(large, "stars")
        after = staged(_small_star(larger, few), "stars")
        released(links)
        if not few:
            released(larger)
        links = after
