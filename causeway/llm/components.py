"""Connected components of a graph of links, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import forget, partitions, stored, tidy


def _attach(rows: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """rows (u, v) with m of their u, from least (u, m, k).

    A node with over hub rows would put them all into one task. There are at most
    rows / hub of those, a few for each task, so they are broadcast and their rows
    stay where they are; the rest meet by a shuffle.
    """
    hubs = F.broadcast(least.filter(F.col("k") > hub).select("u", "m"))
    rest = rows.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("k") <= hub).select("u", "m"), "u")
    return rows.join(hubs, "u").select("u", "v", "m").union(rest.select("u", "v", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node each linked node can reach.

    links: two long columns. Alternates two star steps (hang larger neighbours on
    the smallest; hang smaller ones and itself on the smallest) until every node
    hangs on one other that hangs on none, which takes a number of rounds
    logarithmic in the longest path. A node with a large share of all links is no
    one task's. Tables of earlier rounds are deleted as soon as the next is written.
    """
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    spark = links.sparkSession
    tasks = partitions(spark)
    links, path = stored(links.filter(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        hub = max(1000, links.count() // (8 * tasks))
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("k"))
        large, large_path = stored(_attach(both.filter("v > u"), least, hub).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct())
        small_least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        small = _attach(large, small_least, hub).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v")))
        before, (links, path) = path, stored(small.distinct())
        forget(spark, before, large_path)  # the new links are on disk
        del large, small_least, small, both, least
        tidy(spark)
        nodes = links.union(links.select("v", "u")).groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        if nodes.filter("m < u and k > 1").isEmpty():
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
