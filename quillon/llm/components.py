"""Connected components of links, by alternating large-star and small-star steps; no group is gathered, each step is a minimum and a join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) as a written table: the least node reachable from each node of links (a, b). Nodes without a link aren't listed."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, written(small, "edges")
        dropped(before)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == last:
            stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            found = written(stars.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            dropped(edges)
            return found
        last = now
