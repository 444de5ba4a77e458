"""Connected components of a link table by alternating star contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfind.llm.shared import drop, written


def _large_star(links: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to its least neighbour."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def connected(links: DataFrame) -> DataFrame:
    """u and root (the least node of its component) for every linked node but the roots, as a written table. Takes u and v, not null."""
    links = written(links.select("u", "v").filter("u <> v").distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        links, last = written(_small_star(_large_star(links)), "links"), links
        drop(last)
        if (now := _mark(links)) == mark:
            break
        mark = now
    roots = links.select("u", F.col("v").alias("root"))
    roots.written_to = links.written_to
    return roots
