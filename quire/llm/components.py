"""Connected components of a link table by alternating star contractions.

Each round rewrites the links so that every node points at smaller ones (large
star, then small star); it ends when a round changes nothing. Only DataFrames:
neither links nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
    return both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("hi").agg(F.min("lo").alias("m"))
    kept = least.select("hi", F.col("m").alias("lo"))
    moved = links.join(least, "hi").where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return kept.unionByName(moved).distinct()


def _state(links: DataFrame) -> tuple:
    h = F.xxhash64("hi", "lo").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(h)).first())


def components(links: DataFrame) -> DataFrame:
    """links: hi, lo (long, hi > lo). Returns node, root: every node that has a link, with
    the smallest node it reaches. Repeated links are fine; no links give no rows."""
    links = written(links.select("hi", "lo").distinct(), "links")
    state = _state(links)
    while state[0]:
        links = written(_small_star(_large_star(links)), "links")
        before, state = state, _state(links)
        if state == before:
            break
    pairs = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return pairs.unionByName(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
