"""Connected components by alternating large-star and small-star steps.

Each round is two aggregations and two joins over the links that are left, written to the
shared folder; the number of rounds grows with the logarithm of the longest chain. Nothing but
two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One step. large: each node's larger neighbours are tied to the least of its neighbourhood;
    otherwise its smaller neighbours are."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    return (out.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct())


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """links: (u, v), comparable and non-null. Returns (node, component): the least node reachable,
    for every node that has a link to another."""
    links = common.stored(spark, links.where("u != v").select(F.greatest("u", "v").alias("u"),
                                                              F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        links = common.stored(spark, _star(_star(links, True), False), "links")
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == (now["n"], now["h"]):
            break
        seen = (now["n"], now["h"])
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
