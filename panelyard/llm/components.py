"""Distributed connected components (DataFrame functions only).

Large-star and small-star steps in turn, each pair written to the shared folder. Every
step pre-aggregates a node's smallest neighbour before it joins, so a node of very many
links is joined in parts that Spark can split. Only counts reach the driver. A step's table
is deleted when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link to another: the smallest node it reaches.

    Null ends, loops and repeated links are ignored; no links give an empty table.
    """
    clean = links.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    star = common.written(clean.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    last = None
    while True:
        mark = tuple(star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == last or not mark[0]:
            break
        last = mark
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.where("m < u").select("u", F.col("m").alias("v"))
        ).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        before, star = star, common.written(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct(),
            "links",
        )
        common.dropped(before)
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
