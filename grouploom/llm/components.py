"""Connected components of a link table, as DataFrame jobs.

Alternating large-star and small-star rounds (a published map-reduce algorithm): every round is
a grouped minimum and an equi-join, no neighbour list is ever gathered, and the number of links
never grows. A round's links, least neighbours and large stars are written to the shared folder: each is
used several times, and a round in one plan would hold dozens of exchanges and broadcasts at once, whose
threads and buffers the driver pays for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """``rows`` with m, the least neighbour of u. ``least`` has u, m and the number c of u's rows;
    those with over a thousandth of n rows, at most a thousand, are broadcast, so that the centre of
    a large star doesn't draw all of its rows into one task."""
    hot = F.col("c") > n // 1000 + 1
    marked = rows.join(F.broadcast(least.where(hot).select("u", "m")), "u", "left")
    cold = marked.where("m IS NULL").drop("m").join(least.where(~hot).select("u", "m"), "u")
    return marked.where("m IS NOT NULL").select(cold.columns).unionByName(cold)


def roots(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (columns u, v); root is the smallest node reachable."""
    links = saved(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"
    )
    seen = _digest(links)
    while seen[0]:
        # large star: neighbours above u go to the least of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c")), "least")
        large = saved(_with_least(both.where("v > u"), least, 2 * seen[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: u and its neighbours below go to the least of them
        least = saved(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "least")
        joined = _with_least(large, least, 2 * seen[0])
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = saved(small.distinct(), "links")
        now = _digest(links)
        if now == seen:
            break
        seen = now
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
