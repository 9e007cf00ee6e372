"""Ranks over all rows without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id has a row's place within its partition in its low bits.
_PLACE = (1 << 33) - 1


def ordinal(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """df with each row's place (from 1) in an order that has no ties.

    Rows are range-sorted and kept; a row's place is its place in its partition after the sizes of those before, and
    only these sizes, one a partition, meet in one task.
    """
    placed = df.orderBy(*order).withColumn("part_", F.spark_partition_id()).withColumn("place_", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE))).persist()
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sizes.select("part_", before.alias("before_"))
    return placed.join(F.broadcast(at), "part_").withColumn(name, F.col("before_") + F.col("place_") + 1).drop("part_", "place_", "before_")
