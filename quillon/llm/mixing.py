"""Mixing sources to target weights over a time-varying curriculum; DataFrame functions only.

A source's target is its share of all words by weight, at most ``epochs`` times its own words, the excess reshared by
weight (solved in closed form). A document's copies stand one source-size apart in its source's token stream, which is
ordered by a hash of the document id, documents of over 1/200 of the target first so that the stream is cut between
short ones. Each source's weight runs linearly over training time, w(t) = 1 + ramp * (2t - 1); the copy at token offset
x of a source with target T gets the time t at which the integral of w has demanded x of T. A copy is taken if its
middle lies before T, and the mix is the copies range-sorted by time.

Defined cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; documents
without an id are mixed like others (in the order of a hash of their text); repeated rows each count; an empty table
gives an empty mix; further columns of any name are kept by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, given_back, held, need, written

BUCKET_HEX = 3  # a source's stream is summed in 16 ** BUCKET_HEX hash ranges, never in one task


def size_of(text: Column) -> Column:
    """Words in a whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, total: float = 1.0) -> DataFrame:
    """(source, source_rank, source_size, target): one row for each source.

    With c the words a unit of weight gets, target = min(epochs * size, c * weight). Ordered by epochs * size / weight,
    the saturated sources come first; c is what the rest gets at the first source that isn't saturated.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = per.withColumn("source_rank", F.row_number().over(by_code_point) - 1)
    per = per.withColumn("w", F.element_at(cycle, (F.col("source_rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source_rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    c_here = (F.sum("source_size").over(everything) * F.lit(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("c_here", c_here).withColumn("open", F.col("c_here") * F.col("w") <= F.col("cap"))
    c = F.min_by(F.when(F.col("open"), F.col("c_here")), F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("source_rank")))).over(everything)
    return per.withColumn("c", c).select("source", "source_rank", "source_size", F.when(F.col("c").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("c") * F.col("w"))).alias("target"))


def _ramp() -> Column:
    """A source's slope over training time: falling, level, rising, by its rank."""
    return (F.col("source_rank") % 3 - 1) * F.lit(0.5)


def time_of(x: Column, target: Column, ramp: Column) -> Column:
    """The t in [0, 1] with (1 - ramp) t + ramp t^2 = x / target, the inverse of the integrated weight."""
    y = F.least(F.lit(1.0), x / target)
    return 2 * y / ((1 - ramp) + F.sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * y))


def _sized(text: str = "text") -> list[Column]:
    """What mixing needs of a document: its id (or a hash of its text), source and size."""
    body = F.col(text).cast("string")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64(body)).alias("other"), F.col("source").cast("string").alias("source"), size_of(body).alias("size")]


def plan(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, copies, positions (times of its copies)."""
    sized = written(need(docs, doc_id=T.LongType(), source=T.StringType(), text=T.StringType()).select(*_sized()), "mix-sizes")
    per, sums = _figures(sized, seed, weights, epochs)
    return _placed(sized, per, sums, seed, epochs).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions")


def _keyed(sized: DataFrame, per: DataFrame, seed: int) -> DataFrame:
    """sized with its source's figures and its place: h, rest (whether it is among the short ones) and bucket."""
    keyed = sized.join(per, F.col("source").eqNullSafe(F.col("s_")), "inner").drop("s_")
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("other").cast("string")))
    return keyed.withColumn("h", h).withColumn("rest", (F.col("size") * 200 <= F.col("target")).cast("int")).withColumn("bucket", F.substring("h", 1, BUCKET_HEX))


def _figures(sized: DataFrame, seed: int, weights: tuple[int, ...], epochs: int) -> tuple[DataFrame, DataFrame]:
    """The sources' figures, and the words before each hash range of a source's stream."""
    per = targets(sized, weights, epochs).withColumnRenamed("source", "s_")
    sums = _keyed(sized, per, seed).groupBy("source_rank", "rest", "bucket").agg(F.sum("size").alias("n"))
    order = Window.partitionBy("source_rank").orderBy("rest", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    return per, sums.select("source_rank", "rest", "bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def _placed(sized: DataFrame, per: DataFrame, sums: DataFrame, seed: int, epochs: int) -> DataFrame:
    """sized (doc_id, other, source, size and any more columns) with its source's figures, copies and positions."""
    inside = Window.partitionBy("source_rank", "rest", "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    keyed = _keyed(sized, per, seed).withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    keyed = keyed.join(sums, ["source_rank", "rest", "bucket"]).withColumn("x", (F.col("before") + F.col("inside")).cast("double"))
    step, middle = F.col("source_size"), F.col("x") + F.col("size") / 2
    copies = F.when((F.col("size") > 0) & (step > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(epochs)), F.floor((F.col("target") - middle) / step) + 1))).otherwise(0).cast("int")
    keyed = keyed.withColumn("copies", copies)
    times = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: time_of(middle + k * step, F.col("target"), _ramp()))
    return keyed.withColumn("positions", F.when(F.col("copies") > 0, times).otherwise(F.array().cast("array<double>"))).drop("h", "rest", "bucket", "inside", "before", "x")


def mixed(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, position: str | None = None) -> DataFrame:
    """The mix itself: the columns of docs, one row for each copy taken, range-sorted by training position.

    position: the name of a further column with each copy's time. Without it the order is that of the partitions and of
    the files they are written to, which a reader has to take by name; Spark's own readers don't.
    """
    per, sums = _figures(written(docs.select(*_sized()), "mix-sizes"), seed, weights, epochs)
    placed = _placed(held(docs, *_sized()), written(per, "mix-sources"), written(sums, "mix-ranges"), seed, epochs).where("copies > 0")
    copies = placed.withColumn("time", F.explode("positions")).orderBy("time", "doc_id")
    return copies.select(*given_back(docs), *([F.col("time").alias(position)] if position else []))
